"""Language identification by the nearest of several centroids per language.

A text's letters, lower-cased, with every run of other characters as one
blank, give hashed character trigrams; counts become ``1 + log`` times inverse
document frequency, scaled to length one. Document frequencies are counted over
all learning rows; centroids come from a bounded sample of them by spherical
k-means: ``per_language`` rows and ``k`` centroids a language for up to
``full_languages`` languages. More languages share as many rows and centroids, at
least one each, so every language of the learning rows is learned. The
language of the centroid with the largest cosine wins. A text is rejected when
that cosine is below ``reject`` times the first percentile of the language's own
sample (less for texts of few trigrams), or when it has no letter.

Learning takes the text and language of rows whose CRC-32 of doc_id modulo FOLDS is
not 0; predictions see the text alone.

Defined results: null text and text without a letter are ``und`` with score 0 and rejected; so is
everything where there is nothing to learn from. Rows with a null doc_id are never
learned from and count as held out. Ties go to the language that sorts first.
Repeated rows get equal answers. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import claim, free_name, no_text

#: Fixed values of the learning split.
FOLDS = 5
#: Hash width of trigrams in bits; rows a language that the centroids are fitted on and languages that get as many; share of the bound, and trigrams for all of it.
WIDTH = 14
PER_LANGUAGE, FULL_LANGUAGES, CENTROIDS = 400, 100, 4
REJECT, ENOUGH = 0.3, 600
#: Rows a language that the hash order picks at least: where few are wanted, the first may have no letter.
LEAST_PICKED = 24

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter; built once a worker from Python's Unicode tables."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Hashes of the character trigrams of a text (empty if it has no letter)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.where(is_letter, points, 32).astype(np.uint32)
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    blank = points == 32
    points = points[np.r_[True, ~(blank[1:] & blank[:-1])]]
    mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - WIDTH)).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram hashes of a text and how often each occurs."""
    found = trigrams(text)
    if len(found) > 4096:
        full = np.bincount(found, minlength=1 << WIDTH)
        at = np.flatnonzero(full)
        return at, full[at]
    return np.unique(found, return_counts=True)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language index of each centroid
    centroids: np.ndarray  # (2**WIDTH, centroids)
    idf: np.ndarray
    least: np.ndarray  # rejection bound of each language

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(weight @ weight)
        return weight / norm if norm > 0 else weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        at, n = counts(text or "")
        if not len(at) or not self.languages:
            return "und", 0.0, True
        cosine = self.vector(at, n) @ self.centroids[at]
        best = int(np.argmax(cosine))
        own = int(self.owner[best])
        score = float(np.clip(cosine[best], 0.0, 1.0))
        # few trigrams cannot come near a centroid: the bound grows with their square root up to ENOUGH
        return self.languages[own], score, score < float(self.least[own]) * min(1.0, float(n.sum()) / ENOUGH) ** 0.5


def fold(id_col: str) -> Column:
    """CRC-32 of the id's decimal text, modulo FOLDS; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("language_id", lambda: None)
    seen, rows = np.zeros(1 << WIDTH, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            at, _ = counts(text.as_py())
            seen[at] += 1
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[rows, seen[at]])], ["at", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [counts(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32) for a, _ in pairs], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in pairs], pa.list_(pa.int32()))], ["lang", "at", "n"])


def cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: k centroids of rows of length one, begun from rows far from one another."""
    chosen = [points.mean(axis=0)]
    near = points @ chosen[0]
    start = [int(np.argmax(near))]
    for _ in range(min(k, len(points)) - 1):
        near = np.max(points @ points[start].T, axis=1)
        start.append(int(np.argmin(near)))
    centres = points[start].copy()
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = points[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, full_languages: int = FULL_LANGUAGES, k: int = CENTROIDS, reject: float = REJECT) -> Model:
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), no_text(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != 0))
    order = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    sizes = {r["lang"]: (r["n"], r["first"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(order).alias("first")).collect()}  # a row a language, as in the model
    languages = sorted(sizes)
    if len(languages) > full_languages:
        per_language, k = (max(1, x * full_languages // len(languages)) for x in (per_language, k))
    flat = np.zeros(1 << WIDTH, np.float32)
    none = Model([], np.zeros(0, np.int64), np.zeros((1 << WIDTH, 0), np.float32), flat, np.zeros(0))
    if not languages:
        return none
    # hash order of ids picks about twice the rows wanted (LEAST_PICKED at least, and the first); the bound itself is then kept exactly
    picks = {lang: max(min(1.0, max(2 * per_language, LEAST_PICKED) / n), float(np.nextafter(first, 2.0))) for lang, (n, first) in sizes.items()}
    share = F.element_at(F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(picks[lang]))]), F.col("lang"))
    picked = rows.where(order < share).select("lang", "text")
    sample: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {lang: [] for lang in languages}
    for row in picked.mapInArrow(_sampled, "lang string, at array<int>, n array<int>").toLocalIterator():
        if len(sample[row.lang]) < per_language and row.at:
            sample[row.lang].append((np.asarray(row.at), np.asarray(row.n)))
    frequency = np.zeros(1 << WIDTH)
    total = 0
    for row in rows.select("text").mapInArrow(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        if row["at"] < 0:
            total = row["n"]
        else:
            frequency[row["at"]] = row["n"]
    model = Model([x for x in languages if sample[x]], np.zeros(0, np.int64), flat, np.log((1 + total) / (1 + frequency)).astype(np.float32) + np.float32(0.01), np.zeros(0))
    owner, centres, least = [], [], []
    for i, lang in enumerate(model.languages):
        points = np.zeros((len(sample[lang]), 1 << WIDTH), np.float32)
        for j, (at, n) in enumerate(sample[lang]):
            points[j, at] = model.vector(at, n)
        own = cluster(points, k)
        owner += [i] * len(own)
        centres.append(own)
        least.append(reject * float(np.quantile(np.max(points @ own.T, axis=1), 0.01)))
    if not centres:
        return none
    model.owner, model.centroids, model.least = np.asarray(owner), np.ascontiguousarray(np.concatenate(centres).T), np.asarray(least)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of docs, then __lang, __score and __rejected (with more underscores where docs has such a column)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**WIDTH by at most full_languages * k floats, or one centroid a language if those are more
    names, added = docs.columns, [free_name(docs, name) for name in ("__lang", "__score", "__rejected")]
    at = names.index(text_col)
    # plain names on the way to Python and back: a column of the caller may have a dot in its name
    plain = [f"c{i}" for i in range(len(names) + 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id", lambda: None)
        found = sent.value
        for batch in batches:
            out = [found.predict(text.as_py()) for text in batch.column(at)]
            cols = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], plain)

    types = [*(t for _, t in docs.dtypes), "string", "double", "boolean"]
    schema = ", ".join(f"{c} {t}" for c, t in zip(plain, types, strict=True))
    return docs.toDF(*plain[:-3]).mapInArrow(run, schema).toDF(*names, *added)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    from quillspark.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held, F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))
