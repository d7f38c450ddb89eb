"""Recursive sense trees as flat rows.

The tree has no fixed depth, so it stays JSON until a table function walks it
in pre-order. The same walk exists as a recursive query over VARIANT, for checks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENSE = "group_no int, path array<int>, depth int, sense_id string, number string, def_en string, def_zh string"


class _Walk:
    def eval(self, groups: str | None) -> Iterator[tuple]:
        if not groups:
            return

        def below(senses, group: int, path: list[int]) -> Iterator[tuple]:
            for i, sense in enumerate(senses or []):
                here = [*path, i]
                text = sense.get("definition") or {}
                yield group, here, len(here) - 1, sense.get("id"), sense.get("number"), text.get("en"), text.get("zh")
                yield from below(sense.get("senses"), group, here)

        for n, group in enumerate(json.loads(groups) or []):
            yield from below(group.get("senses"), n, [])


walk_senses = F.udtf(_Walk, returnType=SENSE)


def flat_senses(entries: DataFrame, id_col: str = "id", groups_col: str = "pos_groups") -> DataFrame:
    """(entry_id, SENSE) for all senses of all depths; groups_col holds JSON text."""
    rows = entries.select(F.col(id_col).alias("entry_id"), F.col(groups_col).alias("__g"))
    return rows.lateralJoin(walk_senses(F.col("__g").outer())).drop("__g")


def flat_senses_sql(view: str, most: int = 12) -> str:
    """The same rows by recursion over VARIANT (without the column number)."""
    return f"""
WITH RECURSIVE walk(entry_id, group_no, path, node) AS (
  SELECT e.id, g.pos, array(s.pos), s.value
  FROM {view} e, LATERAL variant_explode(parse_json(e.pos_groups)) g, LATERAL variant_explode(variant_get(g.value, '$.senses', 'variant')) s
  UNION ALL
  SELECT w.entry_id, w.group_no, array_append(w.path, c.pos), c.value
  FROM walk w, LATERAL variant_explode(variant_get(w.node, '$.senses', 'variant')) c WHERE size(w.path) <= {most}
)
SELECT entry_id, group_no, path, size(path) - 1 AS depth, try_variant_get(node, '$.id', 'string') AS sense_id,
       try_variant_get(node, '$.definition.en', 'string') AS def_en, try_variant_get(node, '$.definition.zh', 'string') AS def_zh
FROM walk"""


def language_counts(senses: DataFrame) -> DataFrame:
    """One row: senses with both definitions, English only, Chinese only, none."""
    en, zh = F.coalesce(F.col("def_en") != "", F.lit(False)), F.coalesce(F.col("def_zh") != "", F.lit(False))
    return senses.agg(F.count_if(en & zh).alias("bilingual"), F.count_if(en & ~zh).alias("english_only"), F.count_if(~en & zh).alias("chinese_only"), F.count_if(~en & ~zh).alias("empty"))


def _starts(long: Column, short: Column) -> Column:
    return F.slice(long, 1, F.size(short)) == short


def prune(senses: DataFrame, chosen: DataFrame) -> DataFrame:
    """Senses to show of entries with chosen ids (entry_id, sense_id): the chosen, what is above and what is below them.

    Entries without a chosen sense are shown whole.
    """
    spots = senses.join(chosen, ["entry_id", "sense_id"]).groupBy("entry_id").agg(F.collect_list(F.struct("group_no", "path")).alias("spots"))  # of one entry
    rows = senses.join(spots, "entry_id", "left")
    near = F.exists("spots", lambda s: (s["group_no"] == F.col("group_no")) & (_starts(F.col("path"), s["path"]) | _starts(s["path"], F.col("path"))))
    return rows.where(F.col("spots").isNull() | near).drop("spots")


def first_definition(senses: DataFrame) -> DataFrame:
    """(entry_id, definition): the first non-empty definition in pre-order."""
    text = F.coalesce(F.nullif("def_zh", F.lit("")), F.nullif("def_en", F.lit("")))
    return senses.groupBy("entry_id").agg(F.min_by(F.when(text.isNotNull(), text), F.when(text.isNotNull(), F.struct("group_no", "path"))).alias("definition"))


def attach_variants(variants: DataFrame, senses: DataFrame) -> DataFrame:
    """(variant, sense_id): by anchor, else by number, else the entry's only sense; null where none fits.

    variants: variant, entry_id, anchor, number; senses: entry_id, sense_id, anchor, number.
    """
    by_anchor = senses.where("anchor IS NOT NULL").groupBy("entry_id", "anchor").agg(F.min("sense_id").alias("a"))
    by_number = senses.where("number IS NOT NULL").groupBy("entry_id", "number").agg(F.min("sense_id").alias("b"))
    single = senses.groupBy("entry_id").agg(F.when(F.count("*") == 1, F.min("sense_id")).alias("c"))
    rows = variants.join(by_anchor, ["entry_id", "anchor"], "left").join(by_number, ["entry_id", "number"], "left").join(single, "entry_id", "left")
    return rows.select("variant", F.coalesce("a", "b", "c").alias("sense_id"))


def first_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stable distinct: the first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")
