"""Integrity of packs: rules, duplicates, references, counts, checksums.

Two policies over the same findings: ``collect`` lists them, at most PER_CLASS
of each class and MOST in all, with full counts beside; ``first`` names one and stops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of strings, arrays, nesting and declared counts, kinds, and caps of error lists.
MOST_CHARS, MOST_ITEMS, MOST_DEPTH, MOST_COUNT = 100_000, 20_000, 12, 2_000_000
KINDS = ["word", "derived", "phrasal_verb", "see_also"]
PER_CLASS, MOST = 20, 80


def text_rule(value: Column, name: str, required: bool = False) -> Column:
    """Null where the value is a good string, else the rule's name."""
    long = F.char_length(value) > MOST_CHARS
    bad = F.coalesce(long | (F.trim(value) == ""), F.lit(True)) if required else F.coalesce(long, F.lit(False))
    return F.when(bad, F.lit(name))


def array_rule(value: Column, name: str) -> Column:
    return F.when(F.coalesce(F.size(value) > MOST_ITEMS, F.lit(False)), F.lit(name))


def rule_errors(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def missing_refs(refs: DataFrame, ref: str | list[str], targets: DataFrame, target: str | list[str]) -> DataFrame:
    """Rows whose reference (not null) has no target: a left anti join on the keys."""
    refs_on, targets_on = ([ref], [target]) if isinstance(ref, str) else (ref, target)
    keys = targets.select(*[F.col(t).alias(f"__{i}") for i, t in enumerate(targets_on)])
    on = reduce(lambda a, b: a & b, [refs[r] == keys[f"__{i}"] for i, r in enumerate(refs_on)])
    return refs.where(reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in refs_on])).join(keys, on, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of key values that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reconcile(actual: dict[str, DataFrame], declared: dict[str, int]) -> DataFrame:
    """(name, declared, actual, ok): counted in one job."""
    counts = [df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("name"), F.lit(declared.get(name)).cast("long").alias("declared"), "actual") for name, df in actual.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("ok", F.coalesce(F.col("declared") == F.col("actual"), F.lit(False)))


def capped(findings: DataFrame, per_class: int = PER_CLASS, most: int = MOST) -> DataFrame:
    """The report of findings (class, detail): the first of each class, and the class's full count."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("class").orderBy("detail"))
    total = F.count("*").over(Window.partitionBy("class"))
    rows = findings.withColumns({"place": place, "total": total}).where(F.col("place") <= per_class)
    return rows.orderBy("class", "place").limit(most)  # the cap is the report's


#: The format name that our own packs state; packs of other makers state theirs.
FORMAT = "quill-dict-pack"


def manifest_errors(manifest: dict, product: bool = True, format_name: str = FORMAT) -> list[str]:
    """Errors of a manifest (one small object, on the driver)."""
    found = []
    if manifest.get("format") != format_name or product and manifest.get("format_version") != "1.0":
        found.append("format")
    for name, value in (("pack_id", manifest.get("pack_id")), ("source.name", (manifest.get("source") or {}).get("name"))):
        if not isinstance(value, str) or not value.strip() or len(value) > MOST_CHARS:
            found.append(name)
    counts = manifest.get("counts") or {}
    for name in ("entries", "lookup_keys"):
        n = counts.get(name)
        if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= MOST_COUNT:
            found.append(f"counts.{name}")
    if not isinstance(manifest.get("checksums"), dict):
        found.append("checksums")
    return found


def flat_entry_errors(entries: DataFrame, senses: DataFrame) -> DataFrame:
    """(id, errors) of flat entries (id, headword, display, kind) and their senses (entry_id, sense_id, depth)."""
    per = senses.groupBy("entry_id").agg(F.count("*").alias("n"), F.count_distinct("sense_id").alias("ids"), F.max("depth").alias("deep"), F.count_if(F.coalesce(F.trim("sense_id") == "", F.lit(True))).alias("blank"))
    rows = entries.join(per, entries.id == per.entry_id, "left")
    errors = rule_errors(
        text_rule(F.col("id"), "id", True), text_rule(F.col("headword"), "headword", True), text_rule(F.col("display"), "display"),
        F.when(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), F.lit("kind")),
        F.when(F.col("deep") > MOST_DEPTH, F.lit("depth")), F.when(F.col("blank") > 0, F.lit("sense.id")), F.when(F.col("ids") < F.col("n") - F.col("blank"), F.lit("sense.duplicate")),
    )
    return rows.select("id", errors.alias("errors")).where(F.size("errors") > 0)
