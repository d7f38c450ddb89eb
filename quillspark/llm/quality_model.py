"""Quality classifier: a sparse ensemble of rules over document statistics.

Statistics are built-in expressions over the whole text. Shallow boosted trees
are grown on a bounded sample of labelled rows (``sample`` rows at most, evenly
chosen by a hash of doc_id); every path from a root to a node is a conjunction of
comparisons, hence a rule. A logistic regression with an L1 penalty (FISTA)
keeps few of them. The surviving rules are compiled to one Spark column:
scoring needs no Python and is fused with the statistics.

Learning takes labels of rows whose CRC-32 of doc_id modulo FOLDS is not HELD. Scores use the text alone.

Defined results: null text is scored as empty text; null doc_ids and unlabelled rows are
never learned from, and rows with a null id count as held out; several labels of one doc_id
count as several examples; null labels are no examples. With no labels, or one class only,
the score is the smoothed share of label 1. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, Scratch, no_text, words
from quillspark.llm.quality_rules import let

#: Fixed values of the learning split.
FOLDS, HELD = 3, 1
#: Labelled rows fitted on at most, trees, their depth, split candidates, penalty.
SAMPLE, TREES, DEPTH, CUTS, PENALTY = 20_000, 40, 3, 48, 0.003

STATISTICS = ["n_words", "n_lines", "mean_word", "longest_word", "distinct_share", "echo_share", "upper_share", "digit_share", "symbol_share", "mark_share", "stop_share", "wide_share", "dup_line_share", "words_a_line", "capital_share"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the STATISTICS (double) of each row."""
    text = no_text(text_col)
    chars = F.char_length(text)
    solid = F.char_length(F.translate(text, SPACES, ""))
    without = lambda pattern: chars - F.char_length(F.regexp_replace(text, pattern, ""))
    about = let(
        words(text),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).alias("echo"),
            F.coalesce(F.array_max(F.transform(w, lambda x: F.char_length(x))), F.lit(0)).alias("longest"),
        ),
    )
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), about.alias("w"), lines.alias("l"), solid.alias("solid"),
        without(r"\p{Lu}+").alias("upper"), without("[0-9]+").alias("digits"), (chars - F.char_length(F.translate(text, "#*$%&|<>=_~^{}[]\\/@", ""))).alias("symbols"),
        (chars - F.char_length(F.translate(text, "!?", ""))).alias("marks"), (chars - F.char_length(F.translate(text, ".,;:", ""))).alias("stops"), without(r"[^\x00-\x7F]+").alias("wide"),
    )
    n, lines_n, size = F.greatest(F.col("w.n"), F.lit(1)), F.greatest(F.col("l.n"), F.lit(1)), F.greatest(F.col("solid"), F.lit(1))
    values = {
        "n_words": F.col("w.n"), "n_lines": F.col("l.n"), "mean_word": F.col("solid") / n, "longest_word": F.col("w.longest"), "distinct_share": F.col("w.distinct") / n, "echo_share": F.col("w.echo") / n,
        "upper_share": F.col("upper") / size, "digit_share": F.col("digits") / size, "symbol_share": F.col("symbols") / n, "mark_share": F.col("marks") / n, "stop_share": F.col("stops") / n, "wide_share": F.col("wide") / size,
        "dup_line_share": 1 - F.col("l.distinct") / lines_n, "words_a_line": F.col("w.n") / lines_n, "capital_share": F.col("upper") / n,
    }
    return rows.select("doc_id", *[values[s].cast("double").alias(s) for s in STATISTICS])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound) conjunction


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        """The linear part as a Spark column over the STATISTICS."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for which, above, bound in rule:
                holds = holds & (F.col(STATISTICS[which]) > bound if above else F.col(STATISTICS[which]) <= bound)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def numpy_margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * holds(x, r) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for which, above, bound in rule:
        out &= x[:, which] > bound if above else x[:, which] <= bound
    return out


def grow(x: np.ndarray, residual: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: Rule, rules: dict[Rule, None], step: np.ndarray, rate: float) -> None:
    """One regression tree by Newton gain; adds its paths to ``rules`` and its leaf values to ``step``."""
    g, h = residual[rows].sum(), curve[rows].sum() + 1.0
    best = (1e-6, -1, 0.0)
    if depth:
        for which, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            cell = np.searchsorted(bounds, x[rows, which], side="left")  # cell <= i  <=>  value <= bounds[i]
            left_g = np.cumsum(np.bincount(cell, residual[rows], len(bounds) + 1))[:-1]
            left_h = np.cumsum(np.bincount(cell, curve[rows], len(bounds) + 1))[:-1]
            count = np.cumsum(np.bincount(cell, minlength=len(bounds) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h) - g**2 / h
            gain[(count < 10) | (len(rows) - count < 10)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), which, float(bounds[i]))
    if best[1] < 0:
        step[rows] += rate * g / h
        return
    _, which, bound = best
    above = x[rows, which] > bound
    for side, part in ((False, rows[~above]), (True, rows[above])):
        longer = (*path, (which, side, bound))
        rules[tuple(sorted(longer))] = None
        grow(x, residual, curve, cuts, part, depth - 1, longer, rules, step, rate)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Ensemble(base)
    cuts = [np.unique(np.quantile(column, np.linspace(0.01, 0.99, CUTS))) for column in x.T]
    cuts = [(c[:-1] + c[1:]) / 2 for c in cuts]
    rules: dict[Rule, None] = {}
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), depth, (), rules, margin, 0.3)
    kept: list[Rule] = []
    columns, seen = [], set()
    for rule in rules:
        column = holds(x, rule)
        key = column.tobytes()
        if key not in seen and 5 <= column.sum() <= len(y) - 5:
            seen.add(key)
            kept.append(rule)
            columns.append(column)
    if not kept:
        return Ensemble(base)
    weights, bias = lasso(np.asarray(columns, np.float32).T, y, penalty)
    live = np.flatnonzero(np.abs(weights) > 1e-4)
    return Ensemble(bias, [kept[i] for i in live], [float(weights[i]) for i in live])


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient."""
    n, m = r.shape
    mean = r.mean(axis=0)
    centred = r - mean
    v = np.ones(m) / np.sqrt(m)
    for _ in range(20):  # largest eigenvalue, for the step
        v = centred.T @ (centred @ v)
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    step = 1 / (0.25 * size / n + 0.25)
    w = z = np.zeros(m)
    b = c = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(centred @ z + c)))
        moved = z - step * (centred.T @ (p - y)) / n
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = c - step * float((p - y).mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, float(b - mean @ w)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Rows have doc_id and STATISTICS, labels doc_id and quality; at most ``sample`` of them reach the driver."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold("doc_id") != HELD))
    total = marked.count()
    if not total:
        return Ensemble(0.0)
    share = min(1.0, 0.9 * sample / total)
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    # in a fixed order, so that the same rows are taken, and summed up alike, in every run
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y"), *map(F.col, STATISTICS)]
    found = rows.join(marked, "doc_id").select("doc_id", "y", *STATISTICS).orderBy(*order).limit(sample).toPandas()
    return fit_rules(found[STATISTICS].to_numpy(float), found["y"].to_numpy(float))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    from quillspark.sources.tables import table

    rows = Scratch(spark).save(statistics(table(spark, sf_dir, "documents")), "statistics")
    model = fit(rows, table(spark, sf_dir, "labels"))
    scored = rows.select("doc_id", F.coalesce(fold("doc_id") == HELD, F.lit(True)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
