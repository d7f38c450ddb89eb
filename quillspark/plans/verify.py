"""Reports on packs: every error collected, and answers for words that must be there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import integrity
from quillspark.operators.senses import flat_senses
from quillspark.plans import index, lookup
from quillspark.plans.library import ENTRY, LOOKUP
from quillspark.sources import packs


def pack_report(lines: DataFrame, format_name: str = integrity.FORMAT) -> dict:
    """ok, errors (capped a class and in all), error_count and counts of a pack's lines; nothing stops at the first error."""
    manifest = packs.manifest_of(lines)
    loud = [("manifest", e) for e in integrity.manifest_errors(manifest, product=False, format_name=format_name)] + [("checksum", e) for e in packs.checksum_errors(lines, manifest)]
    entries = packs.parsed(lines, "entries.jsonl", ENTRY).withColumn("parent_id", F.col("parent.id"))
    rows = packs.parsed(lines, "lookup.jsonl", LOOKUP)
    postings, senses = index.unnested(rows), flat_senses(entries.dropDuplicates(["id"])).select("entry_id", "sense_id", "depth")
    name = lambda cls, df, *cols: df.select(F.lit(cls).alias("class"), F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("detail"))
    there = entries.select(F.col("id").alias("entry_id")).distinct()
    found = reduce(
        DataFrame.unionByName,
        [
            name("duplicate_id", integrity.duplicates(entries, "id"), "id", "n"),
            name("duplicate_norm", integrity.duplicates(rows, "norm"), "norm", "n"),
            name("rule", integrity.flat_entry_errors(entries, senses).withColumn("e", F.array_join("errors", ",")), "id", "e"),
            name("missing_entry", integrity.missing_refs(postings, "entry_id", entries, "id"), "norm", "entry_id"),
            name("missing_sense", integrity.missing_refs(postings.where("sense_id <> ''").join(there, "entry_id", "left_semi"), ["entry_id", "sense_id"], senses, ["entry_id", "sense_id"]), "norm", "sense_id"),
            name("missing_parent", integrity.missing_refs(entries, "parent_id", entries, "id"), "id", "parent_id"),
        ],
    )
    report = integrity.capped(found).collect()  # at most MOST rows
    counted = integrity.reconcile({"entries": entries, "lookup_keys": rows}, manifest.get("counts") or {}).collect()
    wrong = [("count", f"{r['name']}: declared {r['declared']}, found {r['actual']}") for r in counted if not r["ok"]]
    totals = {r["class"]: r["total"] for r in report} | ({"manifest": len(loud)} if loud else {}) | ({"count": len(wrong)} if wrong else {})
    errors = [f"{c}: {d}" for c, d in loud + [(r["class"], r["detail"]) for r in report] + wrong]
    return {"ok": not errors, "errors": errors[: integrity.MOST], "error_count": sum(totals.values()), "by_class": totals} | {r["name"]: r["actual"] for r in counted}


def required_words(words: DataFrame, postings: DataFrame, entries: DataFrame, most: int = 6) -> DataFrame:
    """(qid, text, hits, top): how many entries each required text finds, and the first of them with kind and match."""
    answers = lookup.lookup(words, postings, entries, dialect="cli", limit=most)
    place = F.struct("place", F.col("entry.headword").alias("headword"), F.col("entry.kind").alias("kind"), "match")
    top = answers.groupBy("qid").agg(F.array_sort(F.collect_list(place)).alias("top"), (F.max("place") + F.max("omitted")).alias("hits"))
    return words.join(top, "qid", "left").select("qid", "text", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "top")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of report rows."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])
