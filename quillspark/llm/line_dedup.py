"""Line dedup: later copies of repeated line runs are deleted.

Lines (``\\n``-split, blank ones aside) become ids of 128-bit digests, and only
lines that occur twice or more stay in play; a line found once ends every run.
Suffixes of the line-id sequences are sorted by prefix doubling: in round k a
suffix is known by the rank of its first 2**k lines, and the pair (rank here,
rank 2**k lines on) gives the next: a new rank is one more than the number of members of all pairs that
sort before. Pairs are counted first, so a line that a third of all lines repeat is one row a task and pair, and
their counts are added up over range partitions, not within one old rank; unique suffixes leave the sort. Equal ranks
are neighbours in the suffix array: they are its intervals of longest common prefix
at least 2**k, and two overlapping ranks name the interval of any depth between.

A run counts if it has ``least`` words or more. Any repeated run of that weight is the union of
its minimal ones (from a line onward, or back from a line, until the words
suffice), so intervals need naming only at the minimal depths, which never
exceed ``least`` lines; the union of the later members of all these intervals is
exactly the later copies of all maximal repeated runs. Every step is an
aggregation or a join on narrow rows; a frequent line or run is pre-aggregated, its aggregate is written, and the
partitions of the join with it, two plain exchanges, are split by adaptive execution.

"Earlier" is the order (doc_id, row, line); null doc_ids are last. Runs may overlap and may lie in
one document. Defined results: null text stays null; blank lines stay where they
are; a document whose lines are all later copies keeps its row with what is left (empty
text, or its blank lines); repeated rows keep the first; an empty table gives an empty
result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, claim, free_name, row_id

#: Words a repeated run needs; rows of lines sent back at once, and documents rebuilt at once.
LEAST = 10
FLUSH, SLICE = 100_000, 256

LINES = "row_id long, seq int, h1 long, h2 long, ahead int, back int"


def weigh(weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the lines of the least run of ``least`` words that begins, and that ends, there; 0 if there is none."""
    n, upto = len(weights), np.r_[0, np.cumsum(weights)]
    at = np.arange(n)
    end = np.searchsorted(upto, upto[:-1] + least)  # least e with words(at..e) enough
    ahead = np.where(end <= n, end - at, 0)
    start = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    back = np.where(upto[1:] >= least, at + 1 - start, 0)
    return ahead, back


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    claim("line_dedup", lambda: None)
    held: list[list[np.ndarray]] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row_id", "seq", "h1", "h2", "ahead", "back"])

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, text in enumerate(batch.column(1)):
            lines = [x for x in (text.as_py() or "").encode().split(b"\n") if x.strip()]
            n = len(lines)
            if not n:
                continue
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), ">i8").astype(np.int64).reshape(n, 2)
            ahead, back = weigh(np.fromiter((len(x.split()) for x in lines), np.int64, n), least)
            held.append([np.full(n, ids[i]), np.arange(n, dtype=np.int32), digest[:, 0], digest[:, 1], ahead.astype(np.int32), back.astype(np.int32)])
            rows += n
            if rows >= FLUSH:
                yield flush()
                held, rows = [], 0
    if held:
        yield flush()


def prefix_sums(df: DataFrame, order: list[str], value: str, name: str, scratch: Scratch) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all rows before, in ``order`` (unique): range partitions and their offsets."""
    dealt = scratch.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(totals), "__part").withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__base")).drop("__part", "__base")


def rank_levels(lines: DataFrame, depth: int, scratch: Scratch) -> list[DataFrame]:
    """Per round k the suffixes (row_id, seq, rank) whose first 2**k lines occur elsewhere too, up to 2**k <= depth."""
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    first = prefix_sums(twice, ["h1", "h2"], "n", "rank", scratch).select("h1", "h2", (F.col("rank") + 1).alias("rank"))
    levels = [scratch.save(lines.join(first, ["h1", "h2"]).select("row_id", "seq", "rank"), "rank")]
    step = 1
    while 2 * step <= depth:
        here = levels[-1]
        there = here.select("row_id", (F.col("seq") - step).alias("seq"), F.col("rank").alias("second"))
        pairs = scratch.save(here.join(there, ["row_id", "seq"]), "pairs")
        groups = pairs.groupBy("rank", "second").agg(F.count("*").alias("n")).where("n > 1")
        groups = prefix_sums(groups, ["rank", "second"], "n", "before", scratch).select("rank", "second", (F.col("before") + 1).alias("new"))
        levels.append(scratch.save(pairs.join(groups, ["rank", "second"]).select("row_id", "seq", F.col("new").alias("rank")), "rank"))
        scratch.drop(pairs)
        step *= 2
        if levels[-1].isEmpty():
            break
    return levels


def later_lines(docs: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(row_id, seqs): numbers, among the non-blank lines of a row, of the lines to delete; docs has row_id, doc_id, text."""
    lines = scratch.save(docs.select("row_id", "text").mapInArrow(lambda b: _lines(b, least), LINES), "lines")
    depth = lines.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    levels = rank_levels(lines, depth, scratch)
    # minimal runs: (row_id, seq of the first line, lines m)
    onward = lines.where("ahead > 0").select("row_id", "seq", F.col("ahead").alias("m"))
    behind = lines.where("back > 1").select("row_id", (F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("m"))
    runs = onward.unionByName(behind)
    named = None
    for k, ranks in enumerate(levels):
        some = runs.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k)).distinct() if k else runs.where("m = 1")
        some = some.join(ranks.withColumnRenamed("rank", "head"), ["row_id", "seq"])
        if k:
            tails = ranks.withColumnRenamed("rank", "tail").withColumnRenamed("seq", "last")
            some = some.withColumn("last", F.col("seq") + F.col("m") - (1 << k)).join(tails, ["row_id", "last"]).drop("last")
        else:
            some = some.withColumn("tail", F.col("head"))
        some = some.select("row_id", "seq", "m", "head", "tail")
        named = some if named is None else named.unionByName(some)
    named = scratch.save(named, "runs")
    owners = docs.select("row_id", "doc_id").join(named.select("row_id").distinct(), "row_id", "left_semi")
    named = scratch.save(named.join(owners, "row_id"), "owned")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_id").alias("c"), F.col("seq").alias("d"))
    firsts = named.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("m", "head", "tail", F.col("first.c").alias("r"), F.col("first.d").alias("s"))
    firsts = scratch.save(firsts, "firsts")  # written, so that a frequent run's partition of the join below can be split
    later = named.join(firsts, ["m", "head", "tail"]).where("row_id <> r OR seq <> s")
    gone = later.select("row_id", F.explode(F.sequence("seq", F.col("seq") + F.col("m") - 1)).alias("seq"))
    return gone.groupBy("row_id").agg(F.collect_set("seq").alias("seqs"))  # lines of one document


def _rebuilt(batches: Iterator[pa.RecordBatch], text_at: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        texts, counts, gone = [], [], []
        for text, seqs in zip(batch.column(text_at), batch.column(width), strict=True):
            text, drop = text.as_py(), seqs.as_py()
            lines = text.split("\n") if text is not None else []
            number, kept, n = -1, [], 0
            drop = set(drop or ())
            for line in lines:
                if line.strip(" \t\n\x0b\x0c\r"):
                    number += 1
                    if number in drop:
                        n += 1
                        continue
                kept.append(line)
            texts.append(text if not n else "\n".join(kept))
            counts.append(number + 1)
            gone.append(n)
        cols = [batch.column(i) for i in range(width)]
        cols[text_at] = pa.array(texts, pa.string())
        cols += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:width], "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the text cleaned, and n_lines (non-blank) and n_removed; a column of such a name in docs stays, and an underscore is put in front of the new one."""
    scratch = Scratch(docs.sparkSession)
    row, gone_col = free_name(docs, "__row"), free_name(docs, "__gone")
    counts = [free_name(docs, "n_lines"), free_name(docs, "n_removed")]
    whole = scratch.save(docs.withColumn(row, row_id()), "documents")
    names = whole.columns
    keyed = whole.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    work = Scratch(docs.sparkSession)
    gone = scratch.save(later_lines(keyed, least, work), "gone")
    work.drop_all()
    # by sort-merge at every size: the list of lines to delete grows with the corpus
    joined = whole.join(gone.select(F.col("row_id").alias(row), F.col("seqs").alias(gone_col)).hint("merge"), row, "left").select(*(f"`{c}`" for c in names), gone_col)
    at, width = names.index(text_col), len(names)
    # plain names on the way to Python and back: a column of the caller may have a dot in its name
    plain = [f"c{i}" for i in range(width + 1)]
    schema = ", ".join([*(f"{c} {t}" for c, (_, t) in zip(plain, whole.dtypes, strict=False)), "n_lines long", "n_removed long"])
    return joined.toDF(*plain).mapInArrow(lambda b: _rebuilt(b, at, width), schema).toDF(*names, *counts).drop(row)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of ten words or more."""
    from quillspark.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), ln AS (
  SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS seq, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM ln
), reach AS (
  SELECT a.doc_id, a.seq AS s, b.seq AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto - a.upto + a.w >= {LEAST}
), win AS (
  SELECT doc_id, s, min(e) AS e FROM reach GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM reach GROUP BY doc_id, e
), txt AS (
  SELECT doc_id, list(line ORDER BY seq) AS ls FROM ln GROUP BY doc_id
), later AS (
  SELECT doc_id, s, e FROM (
    SELECT doc_id, s, e, row_number() OVER (PARTITION BY array_to_string(ls[s + 1:e + 1], chr(10)) ORDER BY doc_id, s) AS r FROM win JOIN txt USING (doc_id)
  ) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS seq FROM later
), marked AS (
  SELECT raw.doc_id, raw.no, raw.line, ln.seq IS NOT NULL AS solid, gone.seq IS NOT NULL AS out
  FROM raw LEFT JOIN ln USING (doc_id, no) LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.seq = ln.seq
), built AS (
  SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (out) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT out), '') AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE b.text END AS text
FROM documents d LEFT JOIN built b ON d.doc_id = b.doc_id
"""
