"""Conversion: keyed records to entries, postings, ledger, issues and counts.

Pages are parsed once and staged; everything else reads the stage. Redirects are
resolved after all records are known, and give postings of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.textnorm import fold, lookup_keys, loosen
from quillspark.operators import aliases, senses
from quillspark.plans import index
from quillspark.plans.stage import staged
from quillspark.sources.records import BODY_COLUMNS, parse_records, split_links


@dataclass
class Converted:
    entries: DataFrame
    postings: DataFrame
    ledger: DataFrame
    issues: DataFrame


def _loose(column: str):
    return loosen(fold(F.col(column), "cli"), "cli")


def convert(records: DataFrame) -> Converted:
    """records: key, value, ord (the place in the source)."""
    pages, links = split_links(records)
    parsed = staged(parse_records(pages))
    links = staged(links)
    found = parsed.where("id IS NOT NULL")
    place = F.col("ord") * 1000 + F.col("kind_no")
    locator = F.col("record_kind") == "converted_derived_locator"
    rows = found.select("id", place.alias("ord"), "kind", locator.alias("locator"), F.array("key").alias("source_keys"), *BODY_COLUMNS)
    entries = staged(index.merge_entries(rows, BODY_COLUMNS).withColumn("parent_id", F.col("parent.id")))
    direct = found.select(F.explode("postings").alias("p"), "id", "headword", place.alias("ord")).select("p.norm", F.col("id").alias("entry_id"), "p.sense_id", "p.match", "headword", "p.key_raw", "ord")
    ledger = parsed.groupBy("key", "ord", "record_kind").agg(F.array_sort(F.collect_list(F.struct("kind_no", "id"))).alias("x"), F.max(F.size("issues")).alias("issues"))
    ids = F.filter(F.transform("x", lambda x: x["id"]), lambda i: i.isNotNull())
    none = F.lit(None).cast("string")
    ledger = ledger.select("key", F.col("record_kind").alias("status"), ids.alias("entry_ids"), none.alias("link_target"), none.alias("reason"), F.col("issues").cast("long").alias("issues"), "ord")
    redirected, alias_rows = _redirects(links, pages, found, locator)
    last = records.agg(F.max("ord")).first()[0] or 0
    alias_postings = redirected.where("status = 'alias_mapped'").select(F.explode("entry_ids").alias("entry_id"), "key", "ord").join(entries.select(F.col("id").alias("entry_id"), "headword"), "entry_id")
    alias_postings = alias_postings.select(F.explode(lookup_keys(fold(F.col("key"), "cli"), "cli")).alias("norm"), "entry_id", none.alias("sense_id"), F.lit("alias").alias("match"), "headword", F.col("key").alias("key_raw"), ((F.col("ord") + last + 1) * 1000).alias("ord"))
    postings = index.distinct_postings(direct.unionByName(alias_postings))
    issues = parsed.where(F.size("issues") > 0).select("key", "record_kind", F.explode("issues").alias("reason")).distinct().select("key", F.col("record_kind").alias("status"), "reason")
    issues = issues.unionByName(alias_rows.where("status <> 'alias_mapped'").select("key", "status", "reason"))
    return Converted(entries, postings, ledger.unionByName(alias_rows), issues)


def _redirects(links: DataFrame, pages: DataFrame, found: DataFrame, locator) -> tuple[DataFrame, DataFrame]:
    """Redirects with their entries, and their ledger rows: every row of the source has one, repeated keys too."""
    cut = F.trim(F.substring_index("target", "#", 1))
    hops = links.withColumn("cut", cut).withColumn("cut_loose", _loose("cut")).withColumn("key_loose", _loose("key"))
    known = pages.select("key").distinct().withColumn("loose", _loose("key"))
    # the first target is taken whole, fragment and all; later ones without
    names = links.select(F.col("target").alias("name")).distinct().withColumn("loose", _loose("name"))
    starts = aliases.land(names, hops, known)
    walked = aliases.resolve(aliases.alias_edges(hops, known), starts.where("NOT is_record").select(F.col("spot").alias("start")))
    ends = starts.join(walked.withColumnRenamed("start", "spot"), "spot", "left")
    ends = ends.select(F.col("name").alias("target"), F.when(F.col("is_record"), F.col("spot")).otherwise(F.col("resolved")).alias("resolved"), F.when(F.col("is_record"), "ok").otherwise(F.col("status")).alias("how"))
    ids = found.where(~locator | (F.col("kind") == "derived")).groupBy("key").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("kind_no", "id"))), lambda x: x["id"])).alias("entry_ids")).withColumnRenamed("key", "resolved")
    rows = links.join(ends, "target", "left").join(ids, "resolved", "left")
    has = (F.col("how") == "ok") & F.col("entry_ids").isNotNull()
    status = F.when(has, "alias_mapped").otherwise(F.when(F.col("how") == "cycle", "alias_cycle").otherwise("alias_unresolved"))
    reason = F.when(has, None).when(F.col("how").isin("cycle", "too_long"), F.concat_ws(":", "how", "target")).otherwise(F.concat(F.lit("missing:"), F.coalesce("resolved", "target")))
    rows = rows.select("key", "ord", status.alias("status"), F.when(has, F.col("entry_ids")).otherwise(F.array().cast("array<string>")).alias("entry_ids"), F.col("target").alias("link_target"), reason.alias("reason"))
    ledger = rows.select("key", "status", "entry_ids", "link_target", "reason", F.when(F.col("status") == "alias_mapped", 0).otherwise(1).cast("long").alias("issues"), "ord")
    return rows, ledger


def counts(done: Converted) -> DataFrame:
    """(name, n): records by status, entries by kind, senses by language, keys, issues."""
    by_status = done.ledger.groupBy("status").agg(F.count("*").alias("n")).select("status", "n")
    by_kind = done.entries.groupBy(F.concat(F.lit("entries_"), F.col("kind"))).agg(F.count("*").alias("n"))
    flat = senses.language_counts(senses.flat_senses(done.entries).where("group_no IS NOT NULL"))
    tongue = flat.select(F.explode(F.array(*[F.struct(F.lit(f"senses_{c}").alias("name"), F.col(c).alias("n")) for c in flat.columns])).alias("x")).select("x.name", "x.n")
    rest = [(n, df.agg(F.count("*"))) for n, df in (("entries", done.entries), ("lookup_keys", done.postings.select("norm").distinct()), ("issues", done.issues), ("ledger_rows", done.ledger))]
    out = by_status.toDF("name", "n").unionByName(by_kind.toDF("name", "n")).unionByName(tongue)
    for name, df in rest:
        out = out.unionByName(df.select(F.lit(name).alias("name"), F.col("count(1)").alias("n")))
    return out


def pack_tables(done: Converted) -> tuple[DataFrame, DataFrame]:
    """Entries and lookup rows as ``sources.packs.write_pack`` takes them; sense trees are parsed, so that they are written as JSON, not as text."""
    source = F.struct(F.col("source_keys").alias("mdx_keys"), F.col("id").alias("anchor")).alias("source")
    body = [F.parse_json("pos_groups").alias(c) if c == "pos_groups" else F.col(c) for c in BODY_COLUMNS]
    return done.entries.select("id", "kind", source, *body), index.nested(done.postings)


def pairing_counts(nodes: DataFrame) -> DataFrame:
    """Structure of definition nodes (key, en, zh, has_zh_node): by node, then by record, one row."""
    chinese = F.coalesce(F.col("zh").rlike("[一-鿿]"), F.lit(False))
    latin = F.coalesce(F.col("en").rlike("[A-Za-z]"), F.lit(False))
    by = nodes.groupBy("key").agg(F.count("*").alias("nodes"), F.count_if(chinese).alias("zh"), F.count_if(chinese & latin).alias("both"), F.count_if(~F.col("has_zh_node") & latin).alias("en_only"))
    return by.agg(F.sum("nodes").alias("definition_nodes"), F.sum("zh").alias("chinese_nodes"), F.sum("both").alias("chinese_with_english"), F.sum(F.col("zh") - F.col("both")).alias("chinese_without_english"), F.count_if(F.col("zh") > 0).alias("records_with_chinese"), F.count_if((F.col("zh") > 0) & (F.col("en_only") > 0)).alias("records_mixed"))
