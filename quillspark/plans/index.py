"""Building the inverted index: postings, forms, merged entries.

Postings are narrow rows (norm, entry_id, sense_id, match, headword, key_raw,
ord) with the headword's own keys beside them, so that ranking never fetches an
entry. ``ord`` is the order of first appearance and stands in for insertion order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.textnorm import fold, lookup_keys, loosen

IDENTITY = ["norm", "entry_id", "sense_id", "match", "headword", "key_raw"]


def emit(entries: DataFrame, entry_id: Column, headword: Column, match: str, key: Column, ord_: Column, sense_id: Column | None = None, dialect: str = "product", unicode: bool = True) -> DataFrame:
    """One posting per lookup key of ``key``; null and blank keys give none."""
    keys = lookup_keys(fold(key, dialect, unicode), dialect)
    sense = F.lit(None).cast("string") if sense_id is None else sense_id.cast("string")
    return entries.select(F.explode(keys).alias("norm"), entry_id.cast("string").alias("entry_id"), sense.alias("sense_id"), F.lit(match).alias("match"), headword.alias("headword"), key.alias("key_raw"), ord_.cast("long").alias("ord"))


def distinct_postings(postings: DataFrame) -> DataFrame:
    """Repeated postings keep their first place. One aggregation, partial on the map side."""
    return postings.groupBy(*IDENTITY).agg(F.min("ord").alias("ord"))


def with_head_keys(postings: DataFrame, dialect: str = "product", unicode: bool = True) -> DataFrame:
    head = fold(F.coalesce("headword", F.lit("")), dialect, unicode)
    return postings.withColumn("head_exact", head).withColumn("head_loose", loosen(F.col("head_exact"), dialect))


def nested(postings: DataFrame) -> DataFrame:
    """The interchange form: norm and its matches in order, sorted by norm on writing."""
    place = F.struct("ord", "entry_id", "sense_id", "match", "headword", "key_raw")
    rows = postings.groupBy("norm").agg(F.array_sort(F.collect_list(place)).alias("m"))
    return rows.select("norm", F.transform("m", lambda x: F.struct(x["entry_id"].alias("entry_id"), x["sense_id"].alias("sense_id"), x["match"].alias("match"), x["headword"].alias("headword"), x["key_raw"].alias("key_raw"))).alias("matches"))


def unnested(lookup: DataFrame) -> DataFrame:
    return lookup.select("norm", F.posexplode("matches").alias("ord", "m")).select("norm", "m.*", F.col("ord").cast("long"))


def form_rows(entries: DataFrame, forms: str = "form_keys") -> DataFrame:
    """The multi-entry index of forms: a row for each form of each entry."""
    return entries.select(F.explode(forms).alias("norm"), F.col("id").alias("entry_id"), "headword")


def merge_entries(entries: DataFrame, body: list[str]) -> DataFrame:
    """One row per id: the body seen first, and the source keys of all rows in order, once each.

    Columns: id, ord, source_keys (array), locator (boolean), kind, body columns. Rows of a locator
    record add their keys only if they are derived entries; the first row's keys always count.
    """
    first = F.min_by(F.struct(*body, "kind", "source_keys"), "ord").alias("first")
    adds = F.collect_list(F.when(~F.col("locator") | (F.col("kind") == "derived"), F.struct("ord", "source_keys"))).alias("more")
    merged = entries.groupBy("id").agg(first, adds)
    keys = F.array_distinct(F.concat("first.source_keys", F.flatten(F.transform(F.array_sort("more"), lambda x: x["source_keys"]))))
    return merged.select("id", *[F.col(f"first.{c}").alias(c) for c in body], F.col("first.kind").alias("kind"), keys.alias("source_keys"))


def first_per_bucket(rows: DataFrame, bucket: Column, order: list[str], most: int = 3) -> DataFrame:
    """The first rows of each bucket; Spark cuts each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return rows.withColumn("bucket", bucket).withColumn("place", place).where(F.col("place") <= most)


def letter_bucket(key: Column) -> Column:
    letter = F.upper(F.substring(key, 1, 1))
    return F.when(letter.rlike("^[A-Z]$"), letter).otherwise("#")
