"""Revisions over automatic rows, upserts, and the set of work still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(auto: DataFrame, revised: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Full outer by key: where a revision exists its fields win, nulls included; ``revised`` tells which."""
    a = auto.select(key, *fields, F.lit(True).alias("__a"))
    b = revised.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__b"))
    rows = a.join(b, key, "full_outer")
    has = F.col("__b").isNotNull()
    return rows.select(key, *[F.when(has, F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields], has.alias("revised"))


def patch(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows that a patch names, with its fields, marked complete and revised; unknown keys are skipped."""
    changes = patches.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = rows.join(changes, key).withColumns({f: F.col(f"__{f}") for f in fields}).drop(*[f"__{f}" for f in fields])
    return out.withColumns({"complete": F.lit(True), "revised": F.lit(True)})


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; of equal keys the new one."""
    rows = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__v")))
    return rows.withColumn("__p", place).where("__p = 1").drop("__p", "__v")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not among rows done with status ok."""
    return work.join(done.where("status = 'ok'").select(key), key, "left_anti")


def insert_or_ignore(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.dropDuplicates(keys)
