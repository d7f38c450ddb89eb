"""Toxicity severity by a cumulative-link (proportional odds) regression on sparse text features.

Grades are ordered: 0 is not toxic, 1 to TOP are toxic with rising severity. One
weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - b_k)
with b_0 < b_1 < ...; the expected severity is the sum of these probabilities.

Features are hashed: every distinct word (letters, lower-cased) and its first
four to six characters, once a text, so that one slur in a long text weighs as
much as in a short one. Of the hashed features those with a marked surplus in
toxic rows of the sample are kept; the rest weigh nothing.

Labels only say toxic or not. The grade of a toxic training row is the tercile of its
dose: its distinct markers, which are features found in hardly any other rows of
the sample.

The fit uses at most ``sample`` labelled rows, chosen by a hash of doc_id. Scores use the text alone.

Defined results: null or wordless text scores as text without features; null doc_ids and null labels are
never learned from, several labels of one doc_id are several examples. Without labels of both
kinds every severity is TOP times the smoothed share of toxic rows. Repeated rows get equal
scores. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, no_text

#: Grades above 0, labelled rows fitted on at most, least sample rows that hold a feature, features kept, words cached.
TOP, SAMPLE, SEEN, FEATURES, CACHE_WORDS = 3, 12_000, 4, 4_000, 300_000
#: A feature's surplus in toxic rows, in standard deviations, and how many times the usual share of its rows are toxic.
SURPLUS, LIFT = 4.0, 3.0
#: Hash width of features in bits.
WIDTH = 22
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    data = word.encode()
    out = [zlib.crc32(data)]
    out += [zlib.crc32(word[:n].encode(), n) for n in (4, 5, 6) if len(word) > n]
    return [x & (1 << WIDTH) - 1 for x in out]


def text_features(text: str) -> np.ndarray:
    return np.unique(np.fromiter((i for w in set(WORD.findall(text.lower())) for i in word_features(w)), np.int64))


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(TOP))

    def probabilities(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each margin (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.bounds[None, :], -40, 40)))


class Scorer:
    """Margins of texts, with a bounded cache of the features that weigh anything."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}

    def learn(self, word: str) -> tuple[int, ...]:
        hit = tuple(i for i in word_features(word) if i in self.model.weights)
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if len(word) <= 32:
            self.words[word] = hit
        return hit

    def margin(self, text: str | None) -> float:
        get, found = self.words.get, set()
        for word in set(WORD.findall((text or "").lower())):
            hit = get(word)
            if hit is None:
                hit = self.learn(word)
            if hit:
                found.update(hit)
        return sum(self.model.weights[i] for i in sorted(found))


def fit_ordinal(x: list[np.ndarray], grades: np.ndarray, size: int, top: int, penalty: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered bounds of the cumulative-link model; rows of x are indexes of binary features.

    Penalised maximum likelihood of all K binary questions "grade > k" with shared weights, by Adam with
    full gradients. Bounds are the first one plus positive steps, which keeps them ordered.
    """
    n, k = len(grades), top
    at = np.concatenate([np.full(len(f), i) for i, f in enumerate(x)]) if n else np.zeros(0, np.int64)
    col = np.concatenate(x) if n else np.zeros(0, np.int64)
    above = (grades[:, None] > np.arange(k)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    params = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m = v = np.zeros(len(params))
    for t in range(1, rounds + 1):
        w, bounds = params[:size], np.cumsum(np.r_[params[size], np.exp(params[size + 1 :])])
        margin = np.bincount(at, w[col], n) if len(col) else np.zeros(n)
        error = 1 / (1 + np.exp(-np.clip(margin[:, None] - bounds[None, :], -40, 40))) - above
        g_w = (np.bincount(col, error.sum(axis=1)[at], size) if len(col) else np.zeros(size)) + penalty * w
        g_b = -error.sum(axis=0)
        tails = np.cumsum(g_b[::-1])[::-1]
        grad = np.concatenate([g_w, tails[:1], tails[1:] * np.exp(params[size + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return params[:size], np.cumsum(np.r_[params[size], np.exp(params[size + 1 :])])


def flat_model(n: int, bad: int) -> Model:
    share = (bad + 1) / (n + 2)
    return Model({}, np.full(TOP, -float(np.log(share / (1 - share)))))


def fit_rows(ids: list[int], markers: set[int], x: list[np.ndarray], toxic: np.ndarray) -> Model:
    """The model of a sample: hashed ids of the features that count, those of them that are markers, and each row's features (as places in ids) and label."""
    bad = int(toxic.sum())
    marker = np.array([i in markers for i in ids], bool)
    dose = np.array([marker[f].sum() for f in x], float)
    grades = np.zeros(len(x), np.int64)
    cuts = np.quantile(dose[toxic == 1], [j / TOP for j in range(1, TOP)])
    grades[toxic == 1] = 1 + np.searchsorted(cuts, dose[toxic == 1], side="left")
    for j in range(1, TOP + 1):  # equal doses: a grade that none has takes one row, so that all bounds exist
        if not (grades == j).any():
            grades[np.flatnonzero(toxic == 1)[j % bad]] = j
    w, bounds = fit_ordinal(x, grades, len(ids), top=TOP)
    return Model({i: float(a) for i, a in zip(ids, w, strict=True) if abs(a) > 1e-3}, bounds)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_features(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "y", "features"])


def _placed(batches: Iterator[pa.RecordBatch], ids: list[int]) -> Iterator[pa.RecordBatch]:
    sorted_ids = np.array(sorted(ids), np.int64)
    place = {int(i): j for j, i in enumerate(ids)}
    for batch in batches:
        found = [[place[i] for i in np.intersect1d(np.asarray(f.values), sorted_ids).tolist()] for f in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fitted on at most ``sample`` labelled rows, in an order fixed by a hash of their ids.

    All features are counted where the rows are; the driver sees FEATURES of them, and for each row of the
    sample which of these it has.
    """
    scratch = Scratch(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    total = marked.count()
    share = min(1.0, 0.9 * sample / max(total, 1))
    picked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    # the sample is bounded by ``sample`` rows of two numbers, so it may be broadcast to the scan of texts
    rows = docs.select(F.col(id_col).cast("long").alias("id"), no_text(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", "y", "text")
    rows = scratch.save(rows.mapInArrow(_sampled, "id long, y int, features array<long>"), "features")
    if rows.count() > sample:  # only where doc_ids repeat
        rows = scratch.save(rows.orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("features")).limit(sample), "features")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or bad in (0, n):
        return flat_model(n, bad)
    base = (bad + 1) / (n + 2)
    counts = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("seen"), F.sum("y").alias("hits"))
    # surplus in toxic rows over the base rate, in standard deviations
    counts = counts.withColumn("z", (F.col("hits") - F.col("seen") * base) / F.sqrt(F.col("seen") * (base * (1 - base))))
    strong = counts.where((F.col("seen") >= SEEN) & (F.col("z") > SURPLUS) & (F.col("hits") >= LIFT * base * F.col("seen"))).orderBy(F.desc("z"), "f").limit(FEATURES).collect()
    if not strong:
        return flat_model(n, bad)
    ids = [r.f for r in strong]
    found = rows.mapInArrow(lambda batches: _placed(batches, ids), "id long, y int, features array<int>").toPandas()
    lists = sorted((i, y, tuple(f)) for i, y, f in zip(found["id"], found["y"], found["features"], strict=True))
    x = [np.array(f, np.int64) for _, _, f in lists]
    return fit_rows(ids, {r.f for r in strong if r.hits >= 0.9 * r.seen}, x, np.array([y for _, y, _ in lists]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 to TOP), p_toxic, grade (the median grade), toxic (p_toxic >= 1/2)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            margins = np.array([scorer.margin(t.as_py()) for t in batch.column(1)], float)
            above = sent.value.probabilities(margins)
            cols = [batch.column(0), above.sum(axis=1), above[:, 0], (above >= 0.5).sum(axis=1).astype(np.int32), above[:, 0] >= 0.5]
            yield pa.RecordBatch.from_arrays([cols[0], *map(pa.array, cols[1:])], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), no_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    from quillspark.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
