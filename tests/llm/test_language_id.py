"""Language ID: held-out accuracy, a plain version of the cosine, and edges."""

import zlib

import numpy as np
import pytest
from conftest_llm import EDGES

from quillspark.llm import language_id as L
from quillspark.sources.tables import table


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [r for r in L.predict(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r["__lang"] == r.lang for r in rows]) >= 0.97
    assert np.mean([r["__rejected"] for r in rows]) <= 0.01


def test_prediction_equals_dense_cosine(model):
    for text in ("The and of thing", "ñadas de la ción", "z" * 20000 + " et de la", "a"):
        full = np.bincount(L.trigrams(text), minlength=1 << L.WIDTH).astype(float)
        weight = np.where(full > 0, 1 + np.log(np.maximum(full, 1)), 0) * model.idf
        cosine = weight / np.linalg.norm(weight) @ model.centroids
        lang, score, _ = model.predict(text)
        assert lang == model.languages[model.owner[int(np.argmax(cosine))]] and score == pytest.approx(float(np.clip(cosine.max(), 0, 1)), abs=1e-5)


def test_rejects_foreign_script_and_no_letters(model):
    assert model.predict("日本語のテキストです。これは別の文字です。" * 5)[2]
    assert model.predict("123 !!! \U0001f600")[:2] == ("und", 0.0) and model.predict(None)[2] and model.predict("")[2]


def test_edges(spark, make, model):
    rows = L.predict(make(EDGES), model).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert (r["__lang"] == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r["__score"] <= 1
    nothing = L.fit(make([(None, "a b", "en", "s"), (1, None, None, None)]))
    assert {r["__lang"] for r in L.predict(make(["abc", None]), nothing).collect()} == {"und"}
    assert L.predict(make([]), L.fit(make([]))).count() == 0


def test_learns_more_than_a_hundred_languages(spark, make):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(130):
        own = rng.choice([*"abcdefghijklmnopqrstuvwxyzéñüß"], 6, replace=False)
        rows += [(4 * n + i, " ".join("".join(rng.choice(own, 4)) for _ in range(150)), f"l{n:03}", "s") for i in range(4 if n < 110 else 3)]
    docs = make(rows, extra=False)
    learned = {lang for doc_id, _, lang, _ in rows if zlib.crc32(str(doc_id).encode()) % 5}
    assert len(learned) > 100
    many = L.fit(docs)
    assert set(many.languages) == learned
    assert np.mean([many.predict(text)[0] == lang for _, text, lang, _ in rows if lang in learned]) >= 0.95
    few = L.fit(docs, per_language=10, full_languages=13)  # one row a language
    assert set(few.languages) == learned and few.centroids.shape[1] == len(learned)
