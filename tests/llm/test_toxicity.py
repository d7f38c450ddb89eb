"""Ordinal regression: the fit, planted slurs, and edges."""

import numpy as np
import pytest
from conftest_llm import EDGES

from quillspark.llm import toxicity as T
from quillspark.sources.tables import table


def test_fit_orders_bounds_and_shares_weights():
    rng = np.random.default_rng(4)
    true, n = np.array([2.5, 1.5, -1.0, 0.0]), 4000
    x = [np.flatnonzero(rng.random(4) < 0.4) for _ in range(n)]
    margin = np.array([true[f].sum() for f in x]) + rng.logistic(size=n)
    grades = np.searchsorted([1.0, 2.5, 4.0], margin)
    w, bounds = T.fit_ordinal(x, grades, 4, top=3)
    assert np.allclose(w, true, atol=0.3) and np.allclose(bounds, [1.0, 2.5, 4.0], atol=0.3)


def test_gradient_is_that_of_the_likelihood():
    # at the optimum no single weight can be moved to a better penalised likelihood
    x, grades = [np.array([0]), np.array([0, 1]), np.array([1]), np.zeros(0, np.int64)] * 30, np.array([1, 3, 2, 0] * 30)
    w, b = T.fit_ordinal(x, grades, 2, top=3, rounds=2000)

    def loss(w):
        m = np.array([w[f].sum() for f in x])
        p = 1 / (1 + np.exp(-(m[:, None] - b[None, :])))
        up = grades[:, None] > np.arange(3)[None, :]
        return -np.log(np.where(up, p, 1 - p) + 1e-12).sum() + 0.15 * (w**2).sum()

    for i in range(2):
        for d in (-0.2, 0.2):
            moved = w.copy()
            moved[i] += d
            assert loss(moved) >= loss(w) - 1e-3


def test_planted_slurs(spark, make):
    rng = np.random.default_rng(8)
    clean = [f"w{i}" for i in range(300)]
    clean = ["".join(chr(97 + int(c)) for c in str(1000 + i)) for i in range(300)]
    texts, marks = [], []
    for i in range(600):
        words = list(rng.choice(clean, 40))
        bad = i % 9 == 0
        if bad:
            words[5], words[20] = "zorkling", str(rng.choice(["grumpfen", "grumpfos", "grumpfix"]))
        texts.append(" ".join(words))
        marks.append((i, int(bad)))
    docs, labels = make(texts), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = T.fit(docs, labels)
    rows = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all(rows[i].toxic == bool(y) for i, y in marks)
    assert min(rows[i].expected_severity for i, y in marks if y) > max(rows[i].expected_severity for i, y in marks if not y)
    fresh = {r.doc_id: r for r in T.score(make(["long text " * 3000 + "zorkling grumpfyx", "long text " * 3000]), model).collect()}
    assert fresh[0].toxic and not fresh[1].toxic  # a new ending of a known stem, in a long text


def test_severity_is_the_sum_of_the_probabilities(spark, sf):
    docs = table(spark, sf, "documents")
    model = T.fit(docs, table(spark, sf, "labels"))
    scorer = T.Scorer(model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in T.score(docs, model).collect():
        margin = sum(model.weights.get(i, 0.0) for i in T.text_features(texts[r.doc_id]).tolist())
        assert scorer.margin(texts[r.doc_id]) == pytest.approx(margin)
        assert r.expected_severity == pytest.approx(float((1 / (1 + np.exp(model.bounds - margin))).sum()), abs=1e-9)
        assert 0 <= r.expected_severity <= T.TOP


def test_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    model = T.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = T.score(docs.where("doc_id % 2 = 1"), model).selectExpr("doc_id", "toxic AS said", "p_toxic AS p").join(labels.selectExpr("doc_id", "toxic AS y"), "doc_id").collect()
    bad, fine = [r for r in rows if r.y == 1], [r for r in rows if r.y == 0]
    assert len(bad) > 50 and np.mean([r.said for r in bad]) >= 0.8 and np.mean([r.said for r in fine]) <= 0.03
    auc = np.mean([[(a.p > b.p) + (a.p == b.p) / 2 for b in fine] for a in bad])
    assert auc >= 0.9


def test_severity_rises_with_the_dose(spark, make):
    rng = np.random.default_rng(3)
    clean = ["".join(chr(97 + int(c)) for c in str(1000 + i)) for i in range(300)]
    slurs = ["zorkling", "grumpfen", "blemmich", "quostrel", "vrankish", "snoddlep"]
    texts, marks = [], []
    for i in range(900):
        words = list(rng.choice(clean, 40))
        if i % 6 == 0:
            words[: 1 + i // 6 % 6] = slurs[: 1 + i // 6 % 6]
        texts.append(" ".join(words))
        marks.append((i, int(i % 6 == 0)))
    model = T.fit(make(texts), spark.createDataFrame(marks, "doc_id long, toxic int"))
    probe = T.score(make([" ".join(clean[:30] + slurs[:n]) for n in range(7)]), model).collect()
    severity = [r.expected_severity for r in sorted(probe, key=lambda r: r.doc_id)]
    assert severity == sorted(severity) and severity[0] < 0.5 and severity[6] > severity[1] + 0.5


def test_sample_is_the_same_in_every_run(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    models = [T.fit(docs.repartition(n), labels.repartition(n), sample=60) for n in (1, 6)]
    assert models[0].weights == models[1].weights and np.array_equal(models[0].bounds, models[1].bounds)


def test_edges(spark, make):
    docs = make([*EDGES, (None, "no id", "en", "s")])
    for rows in ([], [(1, 1), (3, 0), (None, 1), (4, None), (3, 1)], [(1, 0)]):
        model = T.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = T.score(docs, model).collect()
        assert len(got) == len(EDGES) + 1 and all(0 <= r.expected_severity <= T.TOP for r in got)
    assert T.score(make([]), model).count() == 0
