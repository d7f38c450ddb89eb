"""Batched lookup: a table of query texts answered in one plan.

Narrow first: keys of the queries meet postings, matches are ranked and grouped
per (query, entry) with partial aggregation, the best entries are cut out, and only
these meet the wide entries and their children. Queries are the smaller side;
whether they are broadcast is left to the size the optimizer knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.rank import PHRASAL, rank
from quillspark.functions.textnorm import fold, lookup_keys, loosen, valid_query

#: Entries shown for a query in either dialect.
LIMITS = {"product": 24, "cli": 8}


def query_keys(queries: DataFrame, dialect: str = "product", unicode: bool = True) -> DataFrame:
    """(qid, q_exact, q_loose, key_no, norm) of the valid queries of (qid, text)."""
    rows = queries.where(valid_query(F.col("text"))) if dialect == "product" else queries
    rows = rows.select("qid", fold(F.col("text"), dialect, unicode).alias("q_exact"))
    rows = rows.select("qid", "q_exact", loosen(F.col("q_exact"), dialect).alias("q_loose"))
    return rows.select("*", F.posexplode(lookup_keys(F.col("q_exact"), dialect)).alias("key_no", "norm"))


def matches(keys: DataFrame, postings: DataFrame, forms: DataFrame | None, dialect: str = "product") -> DataFrame:
    """All matches with exactness and rank. Columns of postings: norm, entry_id, sense_id, match, headword, key_raw, ord, head_exact, head_loose."""
    columns = ["norm", "entry_id", "sense_id", "match", "headword", "key_raw", "ord", "head_exact", "head_loose"]
    found = keys.join(postings.select(*columns), "norm").withColumn("source_no", F.lit(0))
    if forms is not None and dialect == "product":
        extra = keys.join(forms, "norm").select(
            *keys.columns, "entry_id", F.lit(None).cast("string").alias("sense_id"), F.lit("inflection").alias("match"), "headword", F.lit(None).cast("string").alias("key_raw"), F.lit(0).cast("long").alias("ord"), "head_exact", "head_loose", F.lit(1).alias("source_no")
        )
        found = found.unionByName(extra)
    exactness = F.when(F.col("head_exact") == F.col("q_exact"), 0).when(F.col("head_loose") == F.col("q_loose"), 1).otherwise(2)
    found = found.withColumn("exactness", exactness).withColumn("rank", rank(F.col("match")))
    if dialect == "cli":  # the same match under both keys counts once, in the place of the first
        found = found.groupBy("qid", "entry_id", "sense_id", "match", "key_raw").agg(F.min(F.struct("exactness", "rank", "headword", "key_no", "ord", "source_no")).alias("x")).select("qid", "entry_id", "sense_id", "match", "key_raw", "x.*")
    return found


def entry_groups(found: DataFrame, dialect: str = "product") -> DataFrame:
    """One row per (qid, entry_id): match (of the best), whole, sense_ids, place, total."""
    tie = F.collate(F.coalesce("headword", F.lit("")), "UNICODE") if dialect == "product" else F.coalesce("headword", F.lit(""))
    best = F.struct("exactness", "rank", tie.alias("tie"), "source_no", "key_no", "ord", "match", "sense_id")
    broad = (F.col("rank") < PHRASAL) | F.coalesce(F.col("sense_id") == "", F.lit(True))
    groups = found.groupBy("qid", "entry_id").agg(F.min(best).alias("best"), F.max(broad).alias("whole"), F.sort_array(F.collect_set(F.when(~broad, F.col("sense_id")))).alias("ids"))
    if dialect == "product":
        senses = F.when(F.col("whole"), F.array().cast("array<string>")).otherwise(F.col("ids"))
    else:  # only the best match of an entry chooses its sense
        chosen = F.when(F.col("best.rank") >= PHRASAL, F.nullif(F.col("best.sense_id"), F.lit("")))
        senses = F.filter(F.array(chosen), lambda s: s.isNotNull())
    order = Window.partitionBy("qid").orderBy("best.exactness", "best.rank", "best.tie", "best.source_no", "best.key_no", "best.ord", "entry_id")
    size = Window.partitionBy("qid")
    return groups.select("qid", "entry_id", F.col("best.match").alias("match"), "whole", senses.alias("sense_ids"), F.row_number().over(order).cast("long").alias("place"), F.count("*").over(size).alias("total"))


def top_entries(groups: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` entries of each query and how many were left out."""
    return groups.where(F.col("place") <= limit).withColumn("omitted", F.greatest(F.lit(0).cast("long"), F.col("total") - limit))


def lookup(queries: DataFrame, postings: DataFrame, entries: DataFrame, forms: DataFrame | None = None, dialect: str = "product", limit: int | None = None, unicode: bool = True) -> DataFrame:
    """Full answers: a row per (qid, entry) with the entry's columns (struct) and its phrasal-verb children.

    In the product dialect entries that are missing from the table are dropped after the limit; in the
    cli dialect only found entries count towards the limit.
    """
    limit = limit or LIMITS[dialect]
    groups = entry_groups(matches(query_keys(queries, dialect, unicode), postings, forms, dialect), dialect)
    packed = entries.select(F.col("id").alias("entry_id"), F.struct(*[c for c in entries.columns]).alias("entry"))
    if dialect == "product":
        answer = top_entries(groups, limit).join(packed, "entry_id")
    else:
        found = groups.join(entries.select(F.col("id").alias("entry_id")), "entry_id")
        again = F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long")
        found = found.withColumn("place", again)
        answer = found.where(F.col("place") <= limit).withColumn("omitted", F.greatest(F.lit(0).cast("long"), F.col("total") - limit)).join(packed, "entry_id")
    children = entries.where((F.col("kind") == "phrasal_verb") & F.col("parent_id").isNotNull())
    wanted = answer.select("entry_id").distinct()
    children = children.join(wanted, children.parent_id == wanted.entry_id, "left_semi")
    related = children.groupBy(F.col("parent_id").alias("entry_id")).agg(F.sort_array(F.collect_list("id")).alias("related"))
    answer = answer.join(related, "entry_id", "left")
    return answer.withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def statuses(queries: DataFrame, answers: DataFrame, has_pack: bool = True) -> DataFrame:
    """(qid, status, n_results): invalid, no-dictionary, not-found or ok."""
    hits = answers.groupBy("qid").agg(F.count("*").alias("n"))
    rows = queries.join(hits, "qid", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    status = F.when(~valid_query(F.col("text")), "invalid").when(F.lit(not has_pack), "no-dictionary").when(n == 0, "not-found").otherwise("ok")
    return rows.select("qid", status.alias("status"), n.alias("n_results"))
