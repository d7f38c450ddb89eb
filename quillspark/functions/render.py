"""Entries as text, for consoles and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many phrases and references an entry shows.
PHRASES, REFERENCES = 12, 8


def definition_text(en: Column, zh: Column) -> Column:
    """Both languages where both are given, Chinese first; a dash where neither is."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" / ", filled(zh), filled(en)), F.lit("")), F.lit("-"))


def head_line(display: Column, headword: Column, homograph: Column, kind: Column) -> Column:
    number = F.when(homograph.isNotNull(), F.concat(F.lit(" "), homograph.cast("string"))).otherwise("")
    return F.concat(F.coalesce(F.nullif(display, F.lit("")), headword), number, F.lit(" ["), kind, F.lit("]"))


def shown_list(items: Column, most: int) -> Column:
    return F.array_join(F.slice(items, 1, most), "; ")


def rendered(entries: DataFrame, senses: DataFrame) -> DataFrame:
    """(entry_id, text): the head line and the senses given, indented by depth, in order.

    Senses are those to show (see operators.senses.prune); a sense with neither definition nor number is left out.
    """
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") + 1), F.when(F.col("number") != "", F.concat(F.col("number"), F.lit(". "))).otherwise("- "), definition_text(F.col("def_en"), F.col("def_zh")))
    lines = senses.where("coalesce(def_en, def_zh, number) IS NOT NULL").select("entry_id", F.struct("group_no", "path", line.alias("line")).alias("s"))
    body = lines.groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("body"))  # of one entry
    heads = entries.select(F.col("id").alias("entry_id"), head_line(F.col("display"), F.col("headword"), F.col("homograph"), F.col("kind")).alias("head"))
    return heads.join(body, "entry_id", "left").select("entry_id", F.concat_ws("\n", "head", "body").alias("text"))


def primary_and_related(answers: DataFrame) -> DataFrame:
    """Adds ``primary``: whether an answer has the headword of its query's first answer."""
    first = answers.groupBy("qid").agg(F.min_by("headword", "place").alias("__h"))
    return answers.join(first, "qid").withColumn("primary", F.col("headword") == F.col("__h")).drop("__h")
