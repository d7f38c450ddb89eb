"""Mixing sources to target weights by entropy balancing.

Of all rates between 0 and ``cap`` copies a document, the mix takes those of least relative
entropy to the corpus (one copy each) under one constraint a source: rate times
size, summed over the source's documents, equals the source's target. The convex dual
has one multiplier a source, and the rates are exponential tilts of the documents
by their size, ``min(cap, exp(multiplier * size))``: a source above its target loses words
where a document costs most of them, one below it gains them there.

Newton's method solves the dual; every iteration is one distributed
aggregation over the table of distinct (source, size) pairs. Multipliers are
whole steps of 1e-12 and rates whole millionths, so the words taken at a multiplier are an
exact integer sum whatever the order of the rows, and the solution is one number: the least
step that reaches the target. Newton's point is tried together with points near it and a few
that cut the bracket, so an iteration always narrows it; not settling is an error.

Rates become whole copies by systematic rounding along the order (size, lane,
doc_id) inside a source: with c the sum of the rates up to a document, it gets
``floor(c + 1/2) - floor(c - rate + 1/2)`` copies, so neighbours in size
make up for one another and the words taken stay within about one document of
the target. c comes from counts of (source, size, lane) cells plus a row number
inside a cell, so that no source, however large, is sorted in one task.

Defined results: null text has size 0; the null source is a source like any
other and sorts last; documents of size 0 take nothing (copies 0); a document
takes at most ``cap`` copies; null doc_ids sort last in their cell; repeated rows
are documents of their own; sources whose target is their cap get the cap for every document. An empty table gives an empty result; if no document
has a word all targets are 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, join_small, no_text, row_id, words

#: Weights by turns of the sorted sources, and the most copies of a document.
WEIGHTS = (1, 2, 3)
CAP = 3
#: Rates are whole millionths, multipliers whole steps of STEP a word; between LOWEST and HIGHEST every rate goes from 0 to the cap.
SCALE, STEP = 1_000_000, 1e-12
LOWEST, HIGHEST = -20_000_000_000_000, 20_000_000_000_000
#: Steps from Newton's point that an iteration tries too, parts into which it cuts the bracket, and the most iterations.
NEARBY, PARTS, MOST_ROUNDS = (-1_000_000, -10_000, -300, -30, -3, -1, 0, 1, 3, 30, 300, 10_000, 1_000_000), 8, 40
#: Cells of equal source and size are split by doc_id into so many lanes.
LANES = 64


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words(no_text(text_col))).cast("long").alias("size"),
        (F.col(row_col) if row_col else row_id()).alias("row_id"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row a source: sid, source, source_size, target (weights' shares of all words, capped and reshared).

    Resharing ends where uncapped sources get ``level * weight``. With sources in the order of
    cap / weight, a source is capped if its cap is within the level that the sources before
    it, all capped, leave. Windows here run over one row a source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order).cast("long"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumns({"weight": turn.cast("long"), "most": F.col("source_size") * cap})
    rise = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    after = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    per = per.withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    per = per.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("sid", "source", "source_size", target.alias("target"), "capped")


def tilted(steps: str, cap: int) -> str:
    """SQL of the rate, in whole millionths, of documents of a ``size`` at a multiplier of so many steps; the exponent stays short of overflow."""
    return f"least({cap * SCALE}L, CAST(round(exp(least(20D, CAST({steps} AS DOUBLE) * {STEP}D * size)) * {SCALE}) AS BIGINT))"


def solve_dual(histogram: DataFrame, aims: DataFrame, scratch: Scratch, cap: int = CAP, most: int = MOST_ROUNDS) -> DataFrame:
    """(sid, multiplier in steps): Newton iterations on the dual; histogram has (sid, size, n), aims (sid, target, capped).

    Only sources with a target between 0 and their cap have one. The state, one row a source,
    is written to the shared folder in every iteration; the driver sees only the widest bracket.
    """
    state = scratch.save(aims.where("target > 0 AND NOT capped").selectExpr("sid", f"CAST(round(target * {SCALE}) AS DECIMAL(38,0)) AS aim", f"{LOWEST}L AS lo", f"{HIGHEST}L AS hi", "0L AS x"), "dual")
    n_sources, wide = state.count(), 0
    points = ", ".join([*(f"x + {near}L" for near in NEARBY), *(f"lo + (hi - lo) * {i} DIV {PARTS}" for i in range(1, PARTS))])
    rate = tilted("p", cap)
    for _ in range(most):
        tried = state.selectExpr("sid", f"explode(array_distinct(transform(array({points}), p -> greatest(lo, least(hi, p))))) AS p")
        sums = (
            join_small(histogram, tried, ["sid"], rows=n_sources * (len(NEARBY) + PARTS))
            .selectExpr("sid", "p", "CAST(n * size AS DECIMAL(20,0)) AS words", "CAST(size AS DOUBLE) AS size", f"{rate} AS rate")
            .groupBy("sid", "p")
            .agg(F.sum(F.expr("words * CAST(rate AS DECIMAL(10,0))")).alias("taken"), F.sum(F.expr(f"CASE WHEN rate < {cap * SCALE} THEN CAST(words AS DOUBLE) * size * rate ELSE 0D END")).alias("slope"))
        )
        # Newton on the logarithm of the words taken, which is the flatter curve
        newton = f"CASE WHEN p = x AND taken > 0 AND slope > 0 THEN x + CAST(floor(greatest(-1e15D, least(1e15D, ln(CAST(aim AS DOUBLE) / CAST(taken AS DOUBLE)) * CAST(taken AS DOUBLE) / slope / {STEP}D))) AS BIGINT) END"
        moved = (
            sums.join(state, "sid")
            .groupBy("sid", "aim", "lo", "hi")
            .agg(F.max(F.expr("CASE WHEN taken < aim THEN p END")).alias("below"), F.min(F.expr("CASE WHEN taken >= aim THEN p END")).alias("above"), F.max(F.expr(newton)).alias("newton"))
            .selectExpr("sid", "aim", "coalesce(below, lo) AS lo", "coalesce(above, hi) AS hi", "newton")
        )
        new = scratch.save(moved.selectExpr("sid", "aim", "lo", "hi", "CASE WHEN newton >= lo AND newton < hi THEN newton ELSE lo + (hi - lo) DIV 2 END AS x"), "dual")
        wide = new.agg(F.max(F.expr("hi - lo"))).first()[0] or 0
        scratch.drop(state)
        state = new
        if wide <= 1:
            return state.select("sid", F.col("hi").alias("multiplier"))
    raise RuntimeError(f"the dual did not settle in {most} iterations; the widest bracket is {wide} steps")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, row_col: str | None = None) -> DataFrame:
    """One row per document: row_id (``row_col`` of a written table, else numbers of this scan), doc_id, source, size, source_size, target, rate_millionths, copies, taken."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(sizes(docs, id_col, text_col, source_col, row_col), "sizes")
    aims = scratch.save(targets(rows, weights, cap), "targets")
    n_sources = aims.count()
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = join_small(rows.withColumn("key", key), aims.select(key.alias("key"), "sid"), ["key"], rows=n_sources)
    # the higher digits of an id count too, so that ids in steps of LANES spread; documents without one by their row
    lane = F.expr(f"pmod(coalesce(doc_id, row_id) + coalesce(doc_id, row_id) DIV {LANES} + coalesce(doc_id, row_id) DIV {LANES * LANES}, {LANES})").alias("lane")
    rows = rows.select("sid", "size", lane, "doc_id", "row_id")
    cells = scratch.save(rows.groupBy("sid", "size", "lane").agg(F.count("*").alias("n")), "cells")
    histogram = scratch.save(cells.where("size > 0").groupBy("sid", "size").agg(F.sum("n").alias("n")), "histogram")
    dual = solve_dual(histogram, aims, scratch, cap)
    sources = scratch.save(aims.join(dual, "sid", "left"), "sources")
    rate = F.expr(f"CASE WHEN capped THEN {cap * SCALE}L ELSE coalesce({tilted('multiplier', cap)}, 0L) END")
    rates = join_small(histogram, sources.select("sid", "multiplier", "capped"), ["sid"], rows=n_sources).select("sid", "size", "n", rate.alias("rate"))
    # millionths before a cell: those of smaller sizes (one row a size), then those of earlier lanes (LANES rows a size)
    smaller = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    lanes = Window.partitionBy("sid", "size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    start = scratch.save(rates.select("sid", "size", "rate", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0)).alias("start")), "start")
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(lanes), F.lit(0))).join(start, ["sid", "size"], "left")
    cells = cells.select("sid", "size", "lane", F.coalesce("rate", F.lit(0)).cast("long").alias("rate"), (F.coalesce("start", F.lit(0)) + F.col("before") * F.coalesce("rate", F.lit(0))).alias("ahead"))
    within = Window.partitionBy("sid", "size", "lane").orderBy(F.col("doc_id").asc_nulls_last(), "row_id")
    placed = rows.withColumn("place", F.row_number().over(within)).join(cells, ["sid", "size", "lane"])
    placed = join_small(placed.withColumn("upto", F.col("ahead") + F.col("place") * F.col("rate")), sources, ["sid"], rows=n_sources)
    copies = F.expr(f"(upto + {SCALE // 2}) DIV {SCALE} - (upto - rate + {SCALE // 2}) DIV {SCALE}")
    return placed.withColumn("copies", copies).select("row_id", "doc_id", "source", "size", "source_size", "target", F.col("rate").alias("rate_millionths"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3 by turns."""
    from quillspark.sources.tables import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate_millionths")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, (sid - 1) % 3 + 1 AS weight, source_size * {CAP} AS most FROM s
), l AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w
), c AS (
  SELECT *, max(CASE WHEN most > level * weight THEN level END) OVER () AS flat FROM l
), c2 AS (
  SELECT sid, source, source_size, most <= level * weight AS capped, CASE WHEN most <= level * weight THEN CAST(most AS DOUBLE) ELSE flat * weight END AS target FROM c
), h AS (
  SELECT sid, d.size, count(*) AS n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WHERE d.size > 0 GROUP BY ALL
), aims AS (
  SELECT sid, CAST(round(target * {SCALE}) AS HUGEINT) AS aim FROM c2 WHERE target > 0 AND NOT capped
), b AS (
  SELECT sid, aim, CAST({LOWEST} AS BIGINT) AS lo, CAST({HIGHEST} AS BIGINT) AS hi FROM aims
  UNION ALL
  SELECT sid, aim, CASE WHEN taken < aim THEN mid ELSE lo END, CASE WHEN taken < aim THEN hi ELSE mid END
  FROM (
    SELECT m.sid, aim, lo, hi, mid, sum(CAST(n * size AS HUGEINT) * least({CAP * SCALE}, CAST(round(exp(least(20.0, CAST(mid AS DOUBLE) * {STEP} * size)) * {SCALE}) AS BIGINT))) AS taken
    FROM (SELECT *, lo + (hi - lo) // 2 AS mid FROM b WHERE hi - lo > 1) m JOIN h ON m.sid = h.sid GROUP BY ALL
  )
), r AS (
  SELECT h.sid, h.size, h.n, CASE WHEN c2.capped THEN {CAP * SCALE} WHEN b.hi IS NULL THEN 0
         ELSE least({CAP * SCALE}, CAST(round(exp(least(20.0, CAST(b.hi AS DOUBLE) * {STEP} * h.size)) * {SCALE}) AS BIGINT)) END AS rate
  FROM h JOIN c2 ON h.sid = c2.sid LEFT JOIN b ON b.sid = h.sid AND b.hi - b.lo = 1
), k AS (
  SELECT d.doc_id, d.size, c2.source_size, c2.target, coalesce(r.rate, 0) AS rate,
         sum(coalesce(r.rate, 0)) OVER (PARTITION BY d.source ORDER BY d.size, (d.doc_id + d.doc_id // {LANES} + d.doc_id // {LANES * LANES}) % {LANES}, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN c2 ON d.source IS NOT DISTINCT FROM c2.source LEFT JOIN r ON r.sid = c2.sid AND r.size = d.size
), n AS (
  SELECT *, CAST((upto + {SCALE // 2}) // {SCALE} - (upto - rate + {SCALE // 2}) // {SCALE} AS BIGINT) AS copies FROM k
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, CAST(rate AS BIGINT) AS rate_millionths FROM n
"""
