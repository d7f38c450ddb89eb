"""The queries of this engine over the driver's tables, each with its DuckDB SQL where SQL can express it.

The reference inputs are not available, so fixture views stand in: dictionary entries
and postings are made of ``part``, texts of ``documents`` and ``conversations``, ordered lines of
``events``, records of ``pages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import textnorm as N
from quillspark.functions.phrases import phrase_keys_udf
from quillspark.operators import aliases, audit, integrity, ocr_entries, overlay, segment, senses
from quillspark.plans import index, lookup
from quillspark.sources import html, records
from quillspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


# -- fixture views -------------------------------------------------------------------------------
KINDS = "CASE p_partkey % 4 WHEN 0 THEN 'word' WHEN 1 THEN 'phrasal_verb' WHEN 2 THEN 'derived' ELSE 'see_also' END"
#: Part names are plain ASCII, so their keys need no compatibility form and the plans stay in the JVM.
ASCII = {"unicode": False}


def fx_entries(spark: SparkSession, sf: str) -> DataFrame:
    parent = "CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey - p_partkey % 10 AS STRING) END AS parent_id"
    return table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS id", "p_name AS headword", "p_brand AS display", f"{KINDS} AS kind", parent)


def fx_postings(spark: SparkSession, sf: str, dialect: str = "product") -> DataFrame:
    part = table(spark, sf, "part")
    ord_ = F.col("p_partkey")
    some = lambda rows, match, key, sense=None: index.emit(rows, F.col("p_partkey"), F.col("p_name"), match, key, ord_, sense, dialect, **ASCII)
    tokens = part.select("*", F.posexplode(F.split("p_name", " ")).alias("no", "token"))
    rows = some(part, "headword", F.col("p_name")).unionByName(some(part, "alias", F.col("p_brand")))
    rows = rows.unionByName(some(tokens, "phrase", F.col("token"), F.col("no"))).unionByName(some(part, "collocation", F.col("p_type")))
    return index.with_head_keys(index.distinct_postings(rows), dialect, **ASCII)


def fx_queries(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select("p_name").distinct()
    names = names.selectExpr("CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS qid", "p_name")  # the distinct names: a few words' combinations
    shaped = "CASE qid % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(p_name, '.') ELSE concat('  ', p_name, ' ') END AS text"
    fixed = spark.createDataFrame(FIXED, "qid long, text string")
    return names.selectExpr("qid", shaped).unionByName(fixed)


FIXED = [(-1, "nosuchthing"), (-2, "<bad>"), (-3, "Brand#7"), (-4, "ring"), (-5, "中文"), (-6, "promo"), (-7, "x" * 161), (-8, "one two three four five six seven eight nine ten eleven twelve thirteen")]

SQL_FIXED = " UNION ALL ".join(f"SELECT CAST({q} AS BIGINT) AS qid, '{t}' AS text" for q, t in FIXED)
SQL_BASE = rf"""
fx_entries AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS headword, p_brand AS display, {KINDS} AS kind,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey - p_partkey % 10 AS VARCHAR) END AS parent_id
  FROM part
), raw AS (
  SELECT lower(p_name) AS norm, CAST(p_partkey AS VARCHAR) AS entry_id, CAST(NULL AS VARCHAR) AS sense_id, 'headword' AS "match", p_name AS headword, p_name AS key_raw, p_partkey AS ord FROM part
  UNION ALL SELECT lower(p_brand), CAST(p_partkey AS VARCHAR), NULL, 'alias', p_name, p_brand, p_partkey FROM part
  UNION ALL SELECT lower(token), CAST(p_partkey AS VARCHAR), CAST(no - 1 AS VARCHAR), 'phrase', p_name, token, p_partkey
            FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) AS no FROM part)
  UNION ALL SELECT lower(p_type), CAST(p_partkey AS VARCHAR), NULL, 'collocation', p_name, p_type, p_partkey FROM part
), postings AS (
  SELECT norm, entry_id, sense_id, "match", headword, key_raw, min(ord) AS ord FROM raw GROUP BY ALL
), names AS (
  SELECT CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS qid, p_name FROM (SELECT DISTINCT p_name FROM part)
), queries AS (
  SELECT qid, CASE qid % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(p_name, '.') ELSE concat('  ', p_name, ' ') END AS text FROM names
  UNION ALL {SQL_FIXED}
), flagged AS (
  SELECT qid, text, length(text) <= 160 AND regexp_matches(text, '[a-zA-Z]') AND len(regexp_split_to_array(trim(text), '\s+')) <= 12 AND NOT regexp_matches(text, '[\r\n<>]') AS ok FROM queries
), folded AS (
  SELECT qid, ok, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS q_exact FROM flagged
), loosed AS (
  SELECT qid, ok, q_exact, trim(regexp_replace(q_exact, '^[.,;:!?·•]+|[.,;:!?·•]+$', '', 'g')) AS q_loose FROM folded
), keys AS (
  SELECT qid, ok, q_exact, q_loose, 0 AS key_no, q_exact AS norm FROM loosed WHERE q_exact <> ''
  UNION ALL SELECT qid, ok, q_exact, q_loose, 1, q_loose FROM loosed WHERE q_loose <> '' AND q_loose <> q_exact
), hits AS (
  SELECT k.qid, k.ok, p.entry_id, p.sense_id, p."match", p.headword, p.key_raw, k.key_no, p.ord,
         CASE WHEN lower(p.headword) = k.q_exact THEN 0 WHEN lower(p.headword) = k.q_loose THEN 1 ELSE 2 END AS exactness,
         CASE p."match" WHEN 'headword' THEN 0 WHEN 'alias' THEN 3 WHEN 'phrase' THEN 6 WHEN 'collocation' THEN 9 ELSE 8 END AS "rank"
  FROM keys k JOIN postings p ON k.norm = p.norm
), best AS (
  SELECT qid, ok, entry_id, min(struct_pack(a := exactness, b := "rank", c := headword, d := key_no, e := ord, f := "match", g := coalesce(sense_id, ''))) AS x,
         max(CASE WHEN "rank" < 6 OR sense_id IS NULL THEN 1 ELSE 0 END) = 1 AS whole,
         count(DISTINCT CASE WHEN "rank" >= 6 THEN sense_id END) AS n_ids
  FROM hits GROUP BY ALL
), placed AS (
  SELECT qid, ok, entry_id, x.f AS "match", x, whole, CASE WHEN whole THEN 0 ELSE n_ids END AS n_senses,
         row_number() OVER (PARTITION BY qid ORDER BY x.a, x.b, x.c, x.d, x.e, entry_id) AS place, count(*) OVER (PARTITION BY qid) AS total
  FROM best
)"""

# -- keys and lookups --------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x0b]+', ' ', 'g')) AS folded FROM documents")
def q01_fold_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.fold(F.col("text")).alias("folded"))


@query(r"""SELECT conv_id, turn, length(text) <= 160 AND regexp_matches(text, '[a-zA-Z]') AND len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) <= 12
           AND NOT regexp_matches(text, '[\r\n<>]') AS ok FROM conversations""")
def q02_valid_query_flags(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", N.valid_query(F.col("text")).alias("ok"))


@query(f'WITH {SQL_BASE} SELECT norm, entry_id, sense_id, "match", headword, key_raw, ord FROM postings')
def q03_postings_build(spark, sf):
    return fx_postings(spark, sf).drop("head_exact", "head_loose")


@query(f'WITH {SQL_BASE} SELECT qid, entry_id, "match", place, total FROM placed')
def q04_lookup_rank(spark, sf):
    found = lookup.matches(lookup.query_keys(fx_queries(spark, sf), "cli", **ASCII), fx_postings(spark, sf, "cli"), None, "cli")
    return lookup.entry_groups(found, "cli").select("qid", "entry_id", "match", "place", "total")


@query(f'WITH {SQL_BASE} SELECT qid, entry_id, "match", whole, CAST(n_senses AS BIGINT) AS n_senses, place, greatest(0, total - 24) AS omitted FROM placed WHERE ok AND place <= 24')
def q05_lookup_top24(spark, sf):
    found = lookup.matches(lookup.query_keys(fx_queries(spark, sf), **ASCII), fx_postings(spark, sf), None)
    top = lookup.top_entries(lookup.entry_groups(found), lookup.LIMITS["product"])
    return top.select("qid", "entry_id", "match", "whole", F.size("sense_ids").cast("long").alias("n_senses"), "place", "omitted")


@query(f"""WITH {SQL_BASE}, related AS (SELECT parent_id, count(*) AS n FROM fx_entries WHERE kind = 'phrasal_verb' GROUP BY parent_id)
SELECT p.qid, p.place, p.entry_id, e.headword, e.display, e.kind, CAST(coalesce(r.n, 0) AS BIGINT) AS n_related
FROM placed p JOIN fx_entries e ON p.entry_id = e.id LEFT JOIN related r ON r.parent_id = e.id WHERE p.ok AND p.place <= 24""")
def q06_lookup_full(spark, sf):
    rows = lookup.lookup(fx_queries(spark, sf), fx_postings(spark, sf), fx_entries(spark, sf), **ASCII)
    return rows.select("qid", "place", "entry_id", "entry.headword", "entry.display", "entry.kind", F.size("related").cast("long").alias("n_related"))


@query(f"""WITH {SQL_BASE}, n AS (SELECT qid, count(*) AS n FROM placed WHERE ok AND place <= 24 GROUP BY qid)
SELECT f.qid, CASE WHEN NOT ok THEN 'invalid' WHEN n IS NULL THEN 'not-found' ELSE 'ok' END AS status, coalesce(n, 0) AS n_results FROM flagged f LEFT JOIN n ON f.qid = n.qid""")
def q07_lookup_status(spark, sf):
    queries = fx_queries(spark, sf)
    return lookup.statuses(queries, lookup.lookup(queries, fx_postings(spark, sf), fx_entries(spark, sf), **ASCII))


@query("""WITH n AS (SELECT CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS qid, p_name FROM (SELECT DISTINCT p_name FROM part))
SELECT n.qid, CAST(p.p_partkey AS VARCHAR) AS entry_id, 'inflection' AS "match", CAST(5 AS INTEGER) AS "rank" FROM n JOIN part p ON p.p_name = n.p_name""")
def q08_form_expansion(spark, sf):
    part = table(spark, sf, "part")
    forms = part.select(F.concat("p_name", F.lit("s")).alias("norm"), F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("headword"))
    queries = part.select("p_name").distinct().selectExpr("CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS qid", "concat(upper(p_name), 's') AS text")
    nothing = fx_postings(spark, sf).where("norm = ''")
    found = lookup.matches(lookup.query_keys(queries, **ASCII), nothing, index.with_head_keys(forms, **ASCII))
    return found.select("qid", "entry_id", "match", "rank")


# -- integrity -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def q09_dangling_entry_refs(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return integrity.missing_refs(items, "l_partkey", table(spark, sf, "part").where("p_partkey % 7 <> 0"), "p_partkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_quantity > 10 AND t.l_partkey = l.l_partkey AND t.l_suppkey = l.l_suppkey)""")
def q10_dangling_sense_refs(spark, sf):
    items = table(spark, sf, "lineitem")
    targets = items.where("l_quantity > 10").select(F.col("l_partkey").alias("e"), F.col("l_suppkey").alias("s")).distinct()
    return integrity.missing_refs(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], targets, ["e", "s"])


@query(f"WITH {SQL_BASE}, part_of AS (SELECT * FROM fx_entries WHERE display <> 'Brand#7') SELECT id, parent_id FROM part_of WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM part_of)")
def q11_parent_integrity(spark, sf):
    some = fx_entries(spark, sf).where("display <> 'Brand#7'")
    return integrity.missing_refs(some.select("id", "parent_id"), "parent_id", some, "id")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def q12_duplicate_ids(spark, sf):
    return integrity.duplicates(table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("""SELECT 'documents' AS name, CAST(1000 AS BIGINT) AS declared, count(*) AS actual, count(*) = 1000 AS ok FROM documents
UNION ALL SELECT 'labelled', 1000, count(*), count(*) = 1000 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def q13_count_reconcile(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return integrity.reconcile({"documents": docs, "labelled": docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")}, {"documents": 1000, "labelled": 1000})


# -- redirects ---------------------------------------------------------------------------------------
#: Every fifth part is a record, every fiftieth in the lower half of each 200: chains of up to 49 hops, some into a cycle or nowhere.
RECORD = "p_partkey % 97 <> 0 AND p_partkey % (CASE WHEN p_partkey % 200 < 100 THEN 50 ELSE 5 END) = 0"
ALIAS = "CASE WHEN p_partkey % 97 = 0 THEN p_partkey + p_partkey % 2 * 12 WHEN p_partkey % 89 = 0 THEN p_partkey + 1000000000 ELSE p_partkey - 1 END"
SQL_ALIAS = f"""
alias AS (SELECT p_partkey AS k, {ALIAS} AS t FROM part WHERE NOT ({RECORD})),
rec AS (SELECT p_partkey AS k FROM part WHERE {RECORD}),
walk AS (
  SELECT k AS start, t AS cur, 1 AS hop, [k] AS seen FROM alias
  UNION ALL
  SELECT w.start, a.t, w.hop + 1, list_append(w.seen, a.k) FROM walk w JOIN alias a ON a.k = w.cur WHERE w.hop < 20 AND NOT list_contains(w.seen, w.cur)
), final AS (SELECT start, arg_max(cur, hop) AS cur, arg_max(seen, hop) AS seen, max(hop) AS hop FROM walk GROUP BY start),
ended AS (SELECT *, cur IN (SELECT k FROM rec) AS mapped, hop < 20 AND list_contains(seen, cur) AS looped, hop < 20 AND NOT list_contains(seen, cur) AS lost FROM final),
ledger AS (
  SELECT CAST(start AS VARCHAR) AS key, CASE WHEN mapped THEN 'alias_mapped' WHEN looped THEN 'alias_cycle' ELSE 'alias_unresolved' END AS status,
         CASE WHEN mapped OR lost THEN CAST(cur AS VARCHAR) END AS resolved
  FROM ended
)"""


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rows = part.where(f"NOT ({RECORD})").selectExpr("CAST(p_partkey AS STRING) AS key", f"CAST({ALIAS} AS STRING) AS cut", "p_partkey AS ord").withColumns({"cut_loose": F.col("cut"), "key_loose": F.col("key")})
    recs = part.where(RECORD).select(F.col("p_partkey").cast("string").alias("key")).withColumn("loose", F.col("key"))
    edges = aliases.alias_edges(rows, recs)
    found = aliases.resolve(edges, rows.select(F.col("key").alias("start")))
    return found.select(F.col("start").alias("key"), aliases.ledger_status(F.col("status")).alias("status"), "resolved")


@query(f"WITH RECURSIVE {SQL_ALIAS} SELECT key, status, resolved FROM ledger")
def q14_alias_resolution(spark, sf):
    return _ledger(spark, sf)


@query(f"WITH RECURSIVE {SQL_ALIAS} SELECT status, count(*) AS n FROM ledger GROUP BY status")
def q15_ledger_status_counts(spark, sf):
    return _ledger(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


# -- audits and windows -----------------------------------------------------------------------------


def _profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS non_empty, count(DISTINCT lower(CAST({c} AS VARCHAR))) AS \"distinct\" FROM {name}" for c in columns)


@query(_profile_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]) + " UNION ALL " + _profile_sql("documents", ["lang", "source", "n_chars"]))
def q16_column_profile(spark, sf):
    return audit.column_profile(table(spark, sf, "customer").drop("c_acctbal")).unionByName(audit.column_profile(table(spark, sf, "documents").select("lang", "source", "n_chars")))


TERMS = [("tools", "bolt"), ("tools", "gear"), ("tools", "anvil"), ("colours", "red"), ("colours", "mauve"), ("phrases", "red widget"), ("phrases", "tiny thing")]


@query("WITH terms(grp, term) AS (VALUES " + ", ".join(f"('{g}', '{t}')" for g, t in TERMS) + ") SELECT grp, term, term IN (SELECT lower(p_name) FROM part) OR term IN (SELECT lower(unnest(string_split(p_name, ' '))) FROM part) AS hit FROM terms")
def q17_coverage_hits_missing(spark, sf):
    part = table(spark, sf, "part")
    words = part.select(F.explode(F.concat(F.array("p_name"), F.split("p_name", " "))).alias("w")).select(F.lower("w").alias("word"))
    return audit.coverage(spark.createDataFrame(TERMS, "grp string, term string"), words)


@query("SELECT event_id, user_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 10000000) - event_id AS size FROM events")
def q18_size_by_lead(spark, sf):
    return audit.sizes_by_lead(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id", F.lit(10000000).cast("long")).drop("ts")


@query("SELECT bucket, c_custkey, place FROM (SELECT upper(c_mktsegment[1:1]) AS bucket, c_custkey, row_number() OVER (PARTITION BY upper(c_mktsegment[1:1]) ORDER BY c_custkey) AS place FROM customer) WHERE place <= 3")
def q19_first3_per_bucket(spark, sf):
    rows = index.first_per_bucket(table(spark, sf, "customer"), index.letter_bucket(F.col("c_mktsegment")), ["c_custkey"])
    return rows.select("bucket", "c_custkey", F.col("place").cast("long").alias("place"))


@query("""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events)
SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(value) AS low, max(value) AS high, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM s GROUP BY user_id, segment""")
def q20_header_segmentation(spark, sf):
    rows = segment.segments(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return segment.segment_summary(rows, ["user_id"], F.col("value"))


@query("SELECT n, count(*) AS groups FROM (SELECT substr(sha256(text), 1, 12) AS d, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) GROUP BY n")
def q21_shared_body_histogram(spark, sf):
    return audit.size_histogram(audit.shared_bodies(table(spark, sf, "documents"), F.col("text")))


@query()
def q22_html_clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.clean_text(F.col("html"), {"ad"}).alias("text"))


@query()
def q23_html_links_xref(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(html.cross_refs(F.col("html"))).alias("r")).select("page_id", "r.text", "r.href")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars % 2 END AS quality,
CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE 0 END AS toxic, l.doc_id IS NOT NULL AS revised
FROM (SELECT doc_id, n_chars FROM documents) d FULL JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels) l ON d.doc_id = l.doc_id""")
def q24_overlay_revision(spark, sf):
    auto = table(spark, sf, "documents").selectExpr("doc_id", "n_chars % 2 AS quality", "0L AS toxic")
    revised = table(spark, sf, "labels").selectExpr("doc_id", "CAST(quality AS BIGINT) AS quality", "CAST(toxic AS BIGINT) AS toxic")
    return overlay.overlay(auto, revised, "doc_id", ["quality", "toxic"])


@query("SELECT doc_id, coalesce(nullif(CASE WHEN lang <> 'en' THEN lang END, ''), nullif(CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END, ''), '') AS definition FROM documents")
def q25_definition_fallback(spark, sf):
    zh, en = F.when(F.col("lang") != "en", F.col("lang")), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise("")
    return table(spark, sf, "documents").select("doc_id", N.definition(zh, en).alias("definition"))


@query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('20260920' || CAST(doc_id AS VARCHAR))) AS place FROM documents) WHERE place <= 2")
def q26_stratified_sample(spark, sf):
    return audit.stratified_sample(table(spark, sf, "documents").select("lang", "doc_id"), "lang", F.col("doc_id"), "20260920", 2)


def fx_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Printed lines: a user's events as pieces on a page of two columns."""
    return table(spark, sf, "events").selectExpr(
        "CAST(user_id AS INT) AS page", "CAST(event_id % 2 AS INT) AS column", "CAST(event_id DIV 4 * 5 AS DOUBLE) AS y0", "CAST(event_id % 7 * 40 AS DOUBLE) AS x0",
        "CAST(event_id DIV 4 * 5 + 9 AS DOUBLE) AS y1", "CAST(event_id % 7 * 40 + 33 AS DOUBLE) AS x1", "event_type AS text", "least(1.0, value / 100) AS score",
    )


@query()
def q27_baseline_merge(spark, sf):
    return segment.merged_lines(fx_lines(spark, sf))


# -- further operators --------------------------------------------------------------------------------


@query("""SELECT page, "column", CAST(row_number() OVER (PARTITION BY page ORDER BY "column", round_even(y0 / 6, 0), x0, y0, text) AS BIGINT) AS line_no, x0, y0
FROM (SELECT CAST(user_id AS INTEGER) AS page, CAST(event_id % 2 AS INTEGER) AS "column", CAST(event_id // 4 * 5 AS DOUBLE) AS y0, CAST(event_id % 7 * 40 AS DOUBLE) AS x0, event_type AS text FROM events)""")
def q28_reading_order(spark, sf):
    return segment.reading_order(fx_lines(spark, sf)).select("page", "column", F.col("line_no").cast("long").alias("line_no"), "x0", "y0")


@query("""SELECT page, "column", min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS line_count
FROM (SELECT CAST(user_id AS INTEGER) AS page, CAST(event_id % 2 AS INTEGER) AS "column", CAST(event_id // 4 * 5 AS DOUBLE) AS y0, CAST(event_id % 7 * 40 AS DOUBLE) AS x0,
      CAST(event_id // 4 * 5 + 9 AS DOUBLE) AS y1, CAST(event_id % 7 * 40 + 33 AS DOUBLE) AS x1 FROM events) GROUP BY page, "column\"""")
def q29_bounding_boxes(spark, sf):
    return segment.bounding_box(fx_lines(spark, sf), ["page", "column"]).select("page", "column", "x0", "y0", "x1", "y1", "line_count")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def q30_most_common(spark, sf):
    return audit.most_common(table(spark, sf, "events"), F.col("event_type"), 3)


@query("""SELECT count(*) FILTER (regexp_matches(html, '[一-鿿]')) AS cjk, count(*) FILTER (regexp_matches(html, '(?i)<script')) AS script, count(*) FILTER (contains(html, '�')) AS replacement,
count(*) FILTER (regexp_matches(html, '(?i)<tran')) AS translation FROM pages""")
def q31_content_flags(spark, sf):
    flags = audit.content_flags(F.col("html"))
    return table(spark, sf, "pages").agg(*[F.count_if(flags[k]).alias(k) for k in ("cjk", "script", "replacement", "translation")])


@query("""WITH e AS (SELECT p_name AS id, p_partkey AS ord, p_brand, p_type, CASE p_partkey % 3 WHEN 0 THEN 'derived' ELSE 'word' END AS kind, p_partkey % 2 = 1 AS locator FROM part),
k AS (SELECT id, p_type, min(ord) AS o FROM e WHERE NOT locator OR kind = 'derived' OR ord = (SELECT min(ord) FROM e e2 WHERE e2.id = e.id) GROUP BY id, p_type)
SELECT f.id, arg_min(f.p_brand, f.ord) AS display, arg_min(f.kind, f.ord) AS kind, any_value(s.keys) AS source_keys FROM e f
JOIN (SELECT id, string_agg(p_type, ',' ORDER BY o) AS keys FROM k GROUP BY id) s ON s.id = f.id GROUP BY f.id""")
def q32_merge_entries(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_name AS id", "p_partkey AS ord", "p_brand AS display", "array(p_type) AS source_keys", "CASE p_partkey % 3 WHEN 0 THEN 'derived' ELSE 'word' END AS kind", "p_partkey % 2 = 1 AS locator")
    return index.merge_entries(rows, ["display"]).withColumn("source_keys", F.array_join("source_keys", ","))


@query(f'WITH {SQL_BASE} SELECT norm, count(*) AS n_matches, string_agg(entry_id || \':\' || "match", \' \' ORDER BY ord, entry_id, sense_id NULLS FIRST, "match") AS listed FROM postings GROUP BY norm')
def q33_nested_postings(spark, sf):
    rows = index.nested(fx_postings(spark, sf))
    listed = F.array_join(F.transform("matches", lambda m: F.concat(m["entry_id"], F.lit(":"), m["match"])), " ")
    return rows.select("norm", F.size("matches").cast("long").alias("n_matches"), listed.alias("listed"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def q34_pending_work(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").selectExpr("l_orderkey AS o_orderkey", "'ok' AS status")
    return overlay.pending(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query()
def q35_phrase_keys(spark, sf):
    texts = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", "[.\n]")).alias("phrase")).where("trim(phrase) <> ''")
    return texts.select("conv_id", "turn", "phrase", phrase_keys_udf(F.col("phrase")).alias("keys"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS entry_id, CAST(depth AS INTEGER) AS depth, CAST(p_partkey AS VARCHAR) || '.' || CAST(depth AS VARCHAR) AS sense_id, CASE WHEN depth % 2 = 0 THEN p_name END AS def_en
FROM (SELECT p_partkey, p_name, unnest(range(0, p_size % 4 + 1)) AS depth FROM part)""")
def q36_flat_senses(spark, sf):
    level = lambda d, inner: f"concat('{{\"id\":\"', p_partkey, '.{d}\",\"definition\":{{\"en\":', " + ("concat('\"', p_name, '\"')" if d % 2 == 0 else "'null'") + f", ',\"zh\":null}},\"senses\":[', {inner}, ']}}')"
    nest = "''"
    for d in (3, 2, 1, 0):
        nest = f"CASE WHEN p_size % 4 >= {d} THEN {level(d, nest)} ELSE '' END"
    trees = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS id", f"concat('[{{\"senses\":[', {nest}, ']}}]') AS pos_groups")
    return senses.flat_senses(trees).select("entry_id", "depth", "sense_id", "def_en")


@query()
def q37_record_parse(spark, sf):
    keyed = table(spark, sf, "pages").selectExpr("url AS key", "html AS value", "page_id AS ord")
    pages, _ = records.split_links(keyed)
    return records.parse_records(pages).select("key", "record_kind", "kind", "headword", F.size("postings").alias("n_postings"))


@query()
def q38_ocr_entries(spark, sf):
    lines = fx_lines(spark, sf).withColumn("window", F.col("page"))
    words = F.concat_ws(" ", "text", F.lit("/ˈtest/ n 1 sample 样本"))
    lines = lines.withColumn("text", F.when(F.col("text") == "signup", words).otherwise(F.col("text")))
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 300.0, 50.0)], "page int, box_no int, x0 double, y0 double, x1 double, y1 double")
    return ocr_entries.parse_lines(lines, boxes, [1, 2, 3]).select("window", "id", "headword_key", "pos", "complete", "line_count")


@query("""SELECT p_partkey, (CASE WHEN p_size % 3 = 0 THEN p_size ELSE 1 END, p_size % 5, 0, 0) > (p_size % 7, p_size % 4, 0, 0) AS newer FROM part""")
def q39_version_newer(spark, sf):
    latest = F.concat_ws(".", F.expr("CASE WHEN p_size % 3 = 0 THEN p_size ELSE 1 END"), F.expr("p_size % 5"))
    return table(spark, sf, "part").select("p_partkey", N.is_newer(latest, F.concat(F.expr("CAST(p_size % 7 AS STRING)"), F.lit("."), F.expr("CAST(p_size % 4 AS STRING)"))).alias("newer"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, 'word' AS kind, p_name AS headword, 'x_' || CAST(p_partkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent, p_type AS def_en, p_brand AS label, CAST(p_size AS VARCHAR) AS number, 'brims' AS form FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'derived', p_name || 'ness', 'd_' || CAST(p_partkey AS VARCHAR), 'x_' || CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN p_type END, NULL, NULL, NULL FROM part""")
def q40_record_fields(spark, sf):
    gloss = "CASE WHEN p_size % 2 = 0 THEN concat('<span class=\"def\"><en>', p_type, '</en></span>') ELSE '' END"
    sense = "'<span class=\"sense\"><span class=\"sensenum\">', p_size, '.</span><span class=\"registerlab\">', p_brand, '</span><span class=\"def\"><en>', p_type, '</en></span></span>'"
    head = "'<a name=\"x_', p_partkey, '\"></a><div class=\"entry\"><span class=\"hwd\">', p_name, '</span><span class=\"pluralform\">brims</span>'"
    html_text = f"concat({head}, {sense}, '<a name=\"d_', p_partkey, '\"></a><span class=\"runon\"><span class=\"deriv\">', p_name, 'ness</span>', {gloss}, '</span></div>')"
    pages = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS key", f"{html_text} AS value", "p_partkey AS ord")
    first = lambda path: F.get_json_object("pos_groups", f"$[0].senses[0].{path}")
    fields = records.parse_records(pages, ["id", "kind", "headword", "inflections", "pos_groups", "parent"])
    return fields.select("key", "kind", "headword", "id", F.col("parent.id").alias("parent"), first("definition.en").alias("def_en"), first("labels[0].value").alias("label"), first("number").alias("number"), F.get("inflections", F.lit(0))["form"].alias("form"))
