"""Quality rules with thresholds that adapt to each language and source.

Measures of every document are integers (parts per thousand), counted by
built-in expressions only. Their distribution per language and source is kept
in a mergeable quantile sketch: a log-linear histogram, exact below 64 and with
a relative error of at most 1/32 above. Its cells are (language, source,
measure, bucket, count) rows: merging two sketches is adding counts, the result
does not depend on the order, and a hot source reaches the shuffle as one row a
task and bucket. Upper and lower fences are the quartiles plus or minus WIDTH spreads.
A spread is the group's interquartile range, or the measure's least spread where that is larger: a
source whose middle half has one value (no symbols, say) would else reject every document that
has one symbol. Quartile and spread both come from the sketch, so a document far outside its own source is
rejected though another source may hold it to be normal. Groups of fewer than ``least`` documents use the
sketch of their language, and languages of fewer the sketch of all documents,
which are sums of the same cells. Documents are then joined with the fences and
filtered.

Base rules come first (``base_failed``); only documents that pass them shape the sketches.

Defined results: null text has no words, all counts 0, and fails the base rules; null
language and null source are groups like any other; null doc_ids and repeated rows are rows
of their own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, Scratch, join_small, no_text, words

#: Characters counted as symbols, window of repeated words, limits of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Measures: name, the least spread (in the measure's unit), whether there is a lower fence.
MEASURES = {
    "symbol_rate": (45, False),
    "echo_rate": (6, False),
    "dup_line_rate": (60, False),
    "upper_rate": (4, False),
    "mark_rate": (55, False),
    "word_length": (150, True),
}
#: Quartiles of the fences in percent, their width in spreads, and the least group.
LOW, HIGH, WIDTH, LEAST = 25, 75, 7, 50
#: Below every value: the lower fence of measures without one.
NO_FENCE = -1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once: a lambda variable, not a copied expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(found: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more in the array."""

    def cover(hashes: Column) -> Column:
        # sort windows by hash, keep positions whose neighbour is equal, then add up the union of their spans
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            same = lambda e, j: (F.get(p, j - 1)["h"] == e["h"]) | (F.get(p, j + 1)["h"] == e["h"])
            at = F.filter(p, lambda e, j: F.coalesce(same(e, j), F.lit(False)))
            return F.array_sort(F.transform(at, lambda e: e["i"]))

        def total(spots: Column) -> Column:
            spans = F.transform(spots, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(spots, j + 1) - s, F.lit(WINDOW))))
            return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, twice), total)

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(cover(h)))

    return let(found, lambda w: F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(windows(w)))


def echoes(found: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(found, lambda x, i: F.coalesce(F.get(found, i - 1) == x, F.lit(False)))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    text = no_text(text_col)
    n_chars = F.char_length(text)
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""), lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("rep"), echoes(w).alias("echo"))).alias("w"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (n_chars - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (n_chars - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (n_chars - F.char_length(F.translate(text, "!?", ""))).cast("long").alias("n_marks"),
        lines.alias("l"),
    )
    return rows.select(
        "doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), "n_upper", "n_marks", F.col("l.all").cast("long").alias("n_lines"), F.col("w.echo").alias("n_echoes"),
        ((F.col("w.n") < LEAST_WORDS) | (100 * F.col("w.rep") > MOST_REPEATED * F.col("w.n"))).alias("base_failed"),
    )


def rates() -> list[Column]:
    rate = lambda part, whole: F.expr(f"coalesce((1000 * {part}) DIV nullif({whole}, 0), 0L)")
    return [
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_echoes", "n_words").alias("echo_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_marks", "n_words").alias("mark_rate"),
        rate("word_chars", "n_words").alias("word_length"),
    ]


def bucket(value: Column) -> Column:
    """Bucket of the log-linear sketch: the value up to 63, else 32 buckets a power of two."""
    power = F.char_length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(power * 32 + F.call_function("shiftright", value, power.cast("int"))).cast("long")


def bucket_top(index: Column) -> Column:
    """The largest value that falls into the bucket."""
    power = F.greatest(F.lit(0), F.expr("cast(b as int) div 32 - 1")).cast("int")
    return F.when(index < 64, index).otherwise(F.call_function("shiftleft", (F.pmod(index, F.lit(32)) + 33).cast("long"), power) - 1).cast("long")


def sketch(rows: DataFrame) -> DataFrame:
    """Cells (lang, source, measure, b, n) of the sketches; add n over sources or languages to merge them."""
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(F.col(name)).alias("b")) for name in MEASURES])
    return rows.select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.measure", "p.b").agg(F.count("*").alias("n"))


def fences(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, size, and a map measure -> (low, high) of the merged sketches at the given keys."""
    merged = cells.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    merged = merged.withColumns({"upto": F.sum("n").over(group.orderBy("b")), "size": F.sum("n").over(group)})
    quart = merged.groupBy(*keys, "measure", "size").agg(*[F.min(F.when(F.col("upto") * 100 >= F.col("size") * p, F.col("b"))).alias(f"q{p}") for p in (LOW, HIGH)])
    for p in (LOW, HIGH):
        quart = quart.withColumn("b", F.col(f"q{p}")).withColumn(f"q{p}", bucket_top(F.col("b")))
    of_measure = lambda at: F.element_at(F.create_map(*[x for k, v in MEASURES.items() for x in (F.lit(k), F.lit(v[at]))]), F.col("measure"))
    spread = F.greatest(of_measure(0).cast("long"), F.col(f"q{HIGH}") - F.col(f"q{LOW}"))
    low = F.when(of_measure(1), F.col(f"q{LOW}") - WIDTH * spread).otherwise(F.lit(NO_FENCE).cast("long"))
    quart = quart.select(*keys, "measure", "size", low.alias("low"), (F.col(f"q{HIGH}") + WIDTH * spread).alias("high"))
    sides = [F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}") for name in MEASURES for side in ("low", "high")]
    return quart.groupBy(*keys).agg(F.max("size").alias("size"), *sides)


def limits_of(cells: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """(key, size, a low and a high fence for each measure): a row for each pair of language and source, from the finest sketch that is large enough."""
    sides = [f"{name}_{side}" for name in MEASURES for side in ("low", "high")]
    fine, coarse = fences(cells, ["lang", "source"]), fences(cells, ["lang"])
    flat = fences(cells.withColumn("one", F.lit(1)), ["one"]).first()  # one row: the sketch of all documents
    # the finest level has a row for each pair of language and source
    pick = fine.alias("f").join(coarse.alias("c"), F.col("f.lang").eqNullSafe(F.col("c.lang")), "left")
    level = lambda s: F.when(F.col("f.size") >= least, F.col(f"f.{s}")).when(F.col("c.size") >= least, F.col(f"c.{s}")).otherwise(F.lit(flat[s] if flat else None).cast("long"))
    return scratch.save(pick.select(group_key(F.col("f.lang"), F.col("f.source")), F.col("f.size").alias("size"), *[level(s).alias(s) for s in sides]), "fences")


def group_key(lang: Column, source: Column) -> Column:
    return F.struct(lang.isNull().alias("a"), F.coalesce(lang, F.lit("")).alias("b"), source.isNull().alias("c"), F.coalesce(source, F.lit("")).alias("d")).alias("key")


def judge(rows: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Rows of measures with kept and failed_rules."""
    rows = scratch.save(rows.select("*", *rates()), "measures")
    limits = limits_of(scratch.save(sketch(rows.where("NOT base_failed")), "sketch"), scratch, least).drop("size")
    joined = join_small(rows.withColumn("key", group_key(F.col("lang"), F.col("source"))), limits, ["key"], "left")
    failed = F.concat_ws(",", *[F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in MEASURES])
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(failed)
    return joined.withColumn("failed_rules", failed).withColumn("kept", F.col("failed_rules") == "")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    from quillspark.sources.tables import table

    rows = judge(measures(table(spark, sf_dir, "documents")), Scratch(spark))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _oracle() -> str:
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM r WHERE NOT base_failed" for m in MEASURES)
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v[0]}" for m, v in MEASURES.items()) + " END"
    fenced = ", ".join(f"'{m}'" for m, v in MEASURES.items() if v[1])
    spread = f"greatest({least}, qh - ql)"

    def level(name: str, keys: str, by: str) -> str:
        return f"""{name}q AS (
  SELECT {keys}measure, max(size) AS size, min(CASE WHEN upto * 100 >= size * {LOW} THEN top END) AS ql, min(CASE WHEN upto * 100 >= size * {HIGH} THEN top END) AS qh
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS size
        FROM (SELECT {keys}measure, b, top, sum(n) AS n FROM cells GROUP BY ALL)) GROUP BY {by}
), {name} AS (
  SELECT {keys}measure, size, CASE WHEN measure IN ({fenced}) THEN ql - {WIDTH} * {spread} ELSE {NO_FENCE} END AS low, qh + {WIDTH} * {spread} AS high FROM {name}q
)"""

    failed = ", ".join(f"CASE WHEN r.{m} < l.{m}_low OR r.{m} > l.{m}_high THEN '{m}' END" for m in MEASURES)
    sides = ", ".join(f"max(CASE WHEN measure = '{m}' THEN low END) AS {m}_low, max(CASE WHEN measure = '{m}' THEN high END) AS {m}_high" for m in MEASURES)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), p AS (
  SELECT rid, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t WHERE len(w) >= {WINDOW})
), f AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM p) WHERE c > 1
), rep AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM f) GROUP BY rid
), m AS (
  SELECT t.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks, len(lines) AS n_lines,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes
  FROM t LEFT JOIN rep USING (rid)
), r AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbol_rate, coalesce(1000 * n_echoes // nullif(n_words, 0), 0) AS echo_rate,
         coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_rate, coalesce(1000 * n_upper // nullif(word_chars, 0), 0) AS upper_rate,
         coalesce(1000 * n_marks // nullif(n_words, 0), 0) AS mark_rate, coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS word_length
  FROM m
), v AS ({cells}), vb AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> CAST(length(bin(v)) - 6 AS BIGINT)) END AS b FROM v
), cells AS (
  SELECT lang, source, measure, b, CASE WHEN b < 64 THEN b ELSE ((b % 32 + 33) << CAST(b // 32 - 1 AS BIGINT)) - 1 END AS top, count(*) AS n FROM vb GROUP BY ALL
), {level("fine", "lang, source, ", "lang, source, measure")}, {level("coarse", "lang, ", "lang, measure")}, {level("flat", "", "measure")},
pick AS (
  SELECT fine.lang, fine.source, fine.measure,
         CASE WHEN fine.size >= {LEAST} THEN fine.low WHEN coarse.size >= {LEAST} THEN coarse.low ELSE flat.low END AS low,
         CASE WHEN fine.size >= {LEAST} THEN fine.high WHEN coarse.size >= {LEAST} THEN coarse.high ELSE flat.high END AS high
  FROM fine JOIN coarse ON fine.lang IS NOT DISTINCT FROM coarse.lang AND fine.measure = coarse.measure JOIN flat ON fine.measure = flat.measure
), l AS (
  SELECT lang, source, {sides} FROM pick GROUP BY lang, source
), o AS (
  SELECT r.*, CASE WHEN base_failed THEN 'base' ELSE concat_ws(',', {failed}) END AS failed_rules
  FROM r LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = '' AS kept, failed_rules FROM o
"""


ORACLE = _oracle()
