"""Profiles of tables and of query coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_profile(rows: DataFrame) -> DataFrame:
    """(column, rows, non_empty, distinct) in one pass over the table; distinct ignores letter case.

    Columns are turned into rows before the exact distinct count, so no wide Expand multiplies the table by column pairs.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.col(c).cast("string")).alias("value")) for c in rows.columns])
    values = rows.select(F.explode(cells).alias("c")).select("c.column", "c.value").groupBy("column", "value").agg(F.count("*").alias("n"))
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    return values.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("non_empty"), F.count_if(F.col("value").isNotNull()).alias("distinct"))


def source_profile(rows: DataFrame, word: Column, spoken: Column, defined: Column) -> DataFrame:
    """Rows, distinct words, words with a pronunciation, words with a definition."""
    return rows.select(word.alias("w"), spoken.alias("p"), defined.alias("d")).agg(F.count("*").alias("rows"), F.count_distinct("w").alias("words"), F.count_distinct(F.when(F.col("p"), F.col("w"))).alias("with_pronunciation"), F.count_distinct(F.when(F.col("d"), F.col("w"))).alias("with_definition"))


def coverage(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(grp, term, hit): which terms (grp, term) are among the words (word)."""
    seen = words.select(F.col("word").alias("term"), F.lit(True).alias("hit")).distinct()
    return terms.join(seen, "term", "left").select("grp", "term", F.coalesce("hit", F.lit(False)).alias("hit"))


def sizes_by_lead(rows: DataFrame, keys: list[str], order: list[str], offset: str, total: Column) -> DataFrame:
    """Adds ``size``: the next row's offset less this one's; the last row's runs to ``total``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("size", F.coalesce(F.lead(offset).over(window), total) - F.col(offset))


def shared_bodies(rows: DataFrame, body: Column) -> DataFrame:
    """(digest, n) of bodies that several rows share; digests are the first twelve hex digits of SHA-256."""
    return rows.select(F.substring(F.sha2(body, 256), 1, 12).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")


def size_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy("n").agg(F.count("*").alias("groups"))


def by_extension(rows: DataFrame, path: Column, size: Column) -> DataFrame:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return rows.select(ext.alias("ext"), size.alias("b")).groupBy("ext").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"))


def most_common(rows: DataFrame, value: Column, most: int) -> DataFrame:
    """The report of the most frequent values; ties go to the lesser value."""
    return rows.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def content_flags(text: Column) -> dict[str, Column]:
    """What the body scan counts: CJK, scripts, replacement and private-use characters, translation tags."""
    return {"cjk": text.rlike("[一-鿿]"), "script": text.rlike("(?i)<script"), "replacement": text.contains("�"), "private_use": text.rlike("[\\ue000-\\uf8ff]"), "translation": text.rlike("(?i)<tran")}


def stratified_sample(rows: DataFrame, stratum: str, key: Column, seed: str, most: int) -> DataFrame:
    """A fixed sample: per stratum the rows that come first in the order of SHA-256(seed, key)."""
    rows = rows.withColumn("__h", F.sha2(F.concat(F.lit(seed), key.cast("string")), 256))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("__h"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most).drop("__h")


def typed_sample(rows: DataFrame, types: list[str], key: str, seed: str, each: int = 2, fill: int = 20) -> DataFrame:
    """A review sample of rows (key, types: array<string>): ``each`` rows a type in turn, none twice, then others up to ``fill``.

    The order is that of SHA-256(seed, type, key), so a sample can be drawn again.
    """
    order = lambda salt: F.sha2(F.concat_ws("\u0001", F.lit(seed), F.lit(salt), F.col(key)), 256)
    picked = None
    for name in types:
        some = rows.where(F.array_contains("types", name))
        if picked is not None:
            some = some.join(picked.select(key), key, "left_anti")
        some = some.orderBy(order(name)).limit(each).select(key, F.lit(name).alias("sample_type"))  # the sample's own bound
        picked = some if picked is None else picked.unionByName(some)
    rest = rows.join(picked.select(key), key, "left_anti").orderBy(order("")).limit(fill).select(key, F.lit("other").alias("sample_type"))
    place = F.row_number().over(Window.orderBy(F.col("sample_type") == "other", order("")))  # fewer than fill + each * types rows
    return picked.unionByName(rest).withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(fill), F.lit(0))).drop("place")
