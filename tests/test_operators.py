"""Redirects, integrity, senses, audits, overlays, segmentation, HTML."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import aliases, audit, integrity, ocr_entries, overlay, segment, senses
from quillspark.sources import html, records


def resolve(spark, edges, recs):
    rows = [(k, t, i) for i, (k, t) in enumerate(edges)]
    df = spark.createDataFrame(rows, "key string, cut string, ord long").withColumns({"cut_loose": F.lower("cut"), "key_loose": F.lower("key")})
    known = spark.createDataFrame([(r,) for r in recs], "key string").withColumn("loose", F.lower("key"))
    found = aliases.resolve(aliases.alias_edges(df, known), df.select(F.col("key").alias("start")))
    return {r.start: (r.resolved, r.status) for r in found.collect()}


def test_alias_cycles_chains_and_missing(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(25)] + [("c25", "REC")]
    got = resolve(spark, [("a", "b"), ("b", "a"), ("in", "a"), ("self", "self"), ("x", "y"), ("y", "rec"), ("lost", "nowhere"), ("far", "lost"), *chain], ["Rec"])
    assert got["a"] == (None, "cycle") and got["in"] == (None, "cycle") and got["self"] == (None, "cycle")
    assert got["x"] == ("Rec", "ok") and got["lost"] == ("nowhere", "missing") and got["far"] == ("nowhere", "missing")
    assert got["c25"] == ("Rec", "ok") and got["c6"] == ("Rec", "ok") and got["c5"][1] == "too_long"


def test_alias_hops_that_count(spark):
    """Twenty hops to a record, nineteen to a dead end or to the key that comes again."""
    lead = lambda name, n, end: [(f"{name}{i}", f"{name}{i + 1}") for i in range(n - 1)] + [(f"{name}{n - 1}", end)]
    got = resolve(spark, [*lead("r", 21, "rec"), *lead("d", 30, "gone"), *lead("c", 29, "p"), ("p", "q"), ("q", "p")], ["rec"])
    assert got["r1"] == ("rec", "ok") and got["r0"][1] == "too_long"
    assert got["d0"] == (None, "too_long") and got["d10"] == (None, "too_long") and got["d11"] == ("gone", "missing")
    assert got["c0"] == (None, "too_long") and got["c11"] == (None, "too_long") and got["c12"] == (None, "cycle")
    edges = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("c", "b", False)], "node string, next string, done boolean")
    assert {r.start: r.reason for r in aliases.resolve(edges, edges.select(F.col("node").alias("start"))).collect()}["a"] == "cycle:a->b->c->b"


def test_last_alias_of_a_key_counts(spark):
    assert resolve(spark, [("k", "gone"), ("k", "rec")], ["rec"])["k"] == ("rec", "ok")


def test_integrity(spark):
    refs = spark.createDataFrame([("k", "e1"), ("k", "e9"), ("k", None)], "norm string, e string")
    ids = spark.createDataFrame([("e1",), ("e1",)], "id string")
    assert [r.e for r in integrity.missing_refs(refs, "e", ids, "id").collect()] == ["e9"]
    assert [tuple(r) for r in integrity.duplicates(ids, "id").collect()] == [("e1", 2)]
    assert {r.name: r.ok for r in integrity.reconcile({"a": ids, "b": refs}, {"a": 2, "b": 4}).collect()} == {"a": True, "b": False}
    findings = spark.range(100).select(F.when(F.col("id") < 70, "x").otherwise("y").alias("class"), F.format_string("%03d", "id").alias("detail"))
    report = integrity.capped(findings).collect()
    assert len(report) == 40 and {(r["class"], r.total) for r in report} == {("x", 70), ("y", 30)}
    good = {"format": integrity.FORMAT, "format_version": "1.0", "pack_id": "p", "source": {"name": "n"}, "counts": {"entries": 1, "lookup_keys": 2_000_000}, "checksums": {}}
    assert integrity.manifest_errors(good) == []
    assert integrity.manifest_errors(good | {"format_version": "2", "counts": {"entries": 0, "lookup_keys": 2_000_001}, "source": {}}) == ["format", "source.name", "counts.entries", "counts.lookup_keys"]
    entries = spark.createDataFrame([("a", "h", None, "word"), ("b", " ", "d", "odd")], "id string, headword string, display string, kind string")
    flat = spark.createDataFrame([("a", "s1", 0), ("a", "s1", 13), ("b", "", 0)], "entry_id string, sense_id string, depth int")
    assert {r.id: r.errors for r in integrity.flat_entry_errors(entries, flat).collect()} == {"a": ["depth", "sense.duplicate"], "b": ["headword", "kind", "sense.id"]}


TREE = [{"senses": [{"id": "1", "definition": {"en": "a", "zh": "甲"}, "senses": [{"id": "1.1", "definition": {"en": "b", "zh": None}}, {"id": "1.2", "definition": {"en": None, "zh": None}, "senses": [{"id": "1.2.1", "definition": {"en": None, "zh": "乙"}}]}]}]}, {"senses": [{"id": "2", "definition": {"en": "c", "zh": ""}}]}]


@pytest.fixture(scope="module")
def trees(spark):
    return spark.createDataFrame([("e", json.dumps(TREE)), ("n", None), ("z", "[]")], "id string, pos_groups string")


def test_sense_walk_equals_recursive_sql(spark, trees):
    flat = senses.flat_senses(trees)
    rows = flat.where("sense_id IS NOT NULL").collect()
    assert [r.sense_id for r in sorted(rows, key=lambda r: (r.group_no, r.path))] == ["1", "1.1", "1.2", "1.2.1", "2"]
    trees.createOrReplaceTempView("sense_trees")
    sql = spark.sql(senses.flat_senses_sql("sense_trees"))
    pick = lambda d: sorted(map(str, d.where("sense_id IS NOT NULL").select("entry_id", "group_no", "path", "depth", "sense_id", "def_en", "def_zh").collect()))
    assert pick(sql) == pick(flat)


def test_sense_counts_pruning_and_fallback(spark, trees):
    flat = senses.flat_senses(trees).where("sense_id IS NOT NULL")
    assert tuple(senses.language_counts(flat).first()) == (1, 2, 1, 1)
    chosen = spark.createDataFrame([("e", "1.2")], "entry_id string, sense_id string")
    assert {r.sense_id for r in senses.prune(flat, chosen).collect()} == {"1", "1.2", "1.2.1"}
    assert senses.prune(flat, chosen.limit(0)).count() == 5
    assert senses.first_definition(flat).first().definition == "甲"
    variants = spark.createDataFrame([("v1", "e", "a2", None), ("v2", "e", None, "2"), ("v3", "e", None, "9"), ("v4", "f", None, None)], "variant string, entry_id string, anchor string, number string")
    known = spark.createDataFrame([("e", "s1", "a1", "1"), ("e", "s2", "a2", "2"), ("f", "t1", None, None)], "entry_id string, sense_id string, anchor string, number string")
    assert {r.variant: r.sense_id for r in senses.attach_variants(variants, known).collect()} == {"v1": "s2", "v2": "s2", "v3": None, "v4": "t1"}


def test_audits(spark):
    df = spark.createDataFrame([("A", 1), ("a", 2), ("", 3), (None, 4)], "w string, n int")
    assert {r["column"]: (r.rows, r.non_empty, r.distinct) for r in audit.column_profile(df).collect()} == {"w": (4, 2, 2), "n": (4, 4, 4)}
    row = audit.source_profile(df.where("w <> ''"), F.lower("w"), F.col("n") > 1, F.lit(False)).first()
    assert tuple(row) == (2, 1, 1, 0)
    files = spark.createDataFrame([("a/b.MP3", 5), ("c.mp3", 7), ("d", 1)], "p string, s long")
    assert {r.ext: (r.files, r.bytes) for r in audit.by_extension(files, F.col("p"), F.col("s")).collect()} == {"mp3": (2, 12), "": (1, 1)}


def test_overlay_null_wins_and_upsert(spark):
    auto = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    revised = spark.createDataFrame([(1, None, "z"), (3, "n", None)], "id int, x string, y string")
    assert {r.id: (r.x, r.y, r.revised) for r in overlay.overlay(auto, revised, "id", ["x", "y"]).collect()} == {1: (None, "z", True), 2: ("c", "d", False), 3: ("n", None, True)}
    assert {r.id: r.x for r in overlay.upsert(auto, revised, "id").collect()} == {1: None, 2: "c", 3: "n"}
    assert [(r.id, r.x, r.complete) for r in overlay.patch(auto, revised, "id", ["x"]).collect()] == [(1, None, True)]


def lines(*rows):
    return pd.DataFrame([(1, c, float(y), float(x), y + 10.0, x + float(w), t, s) for c, y, x, w, t, s in rows], columns=["page", "column", "y0", "x0", "y1", "x1", "text", "score"])


def test_baseline_merge_folds_left_to_right(spark):
    merged = segment.merged_lines(spark.createDataFrame(lines((0, 0, 50, 20, "def", 0.9), (0, 2, 0, 45, "abc ", 0.8), (0, 4, 90, 10, "2", 0.7), (0, 4.5, 104, 10, "x", 1.0), (0, 30, 0, 9, "next", 1.0), (1, 0, 0, 9, "other column", 1.0))))
    got = merged.orderBy("column", "y0").toPandas()
    assert got["text"].tolist() == ["abcdef 2 x", "next", "other column"]
    assert got["score"].tolist() == [0.7, 1.0, 1.0] and got["x1"].tolist()[0] == 114


def test_boxes_first_wins(spark):
    df = spark.createDataFrame(lines((0, 0, 0, 10, "in", 1.0), (0, 500, 0, 10, "out", 1.0)))
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 20.0), (1, 0, -5.0, -5.0, 30.0, 30.0)], "page int, box_no int, x0 double, y0 double, x1 double, y1 double")
    assert {r.text: r.box.box_no if r.box else None for r in segment.in_boxes(df, boxes).collect()} == {"in": 0, "out": None}


def test_line_classes_follow_the_box_state(spark):
    rows = lines((0, 0, 0, 9, "is left over text of the page before", 1.0), (0, 20, 0, 9, "re•sist /rɪˈzɪst/ v", 1.0), (0, 40, 0, 9, "1 to oppose 抵抗", 1.0), (0, 60, 0, 9, "COLLOCATIONS", 1.0), (0, 80, 0, 9, "resist strongly 强烈抵抗", 1.0), (0, 200, 0, 9, "3 after the box", 1.0), (0, 220, 0, 9, "4 free again", 1.0), (0, 240, 0, 9, "→see other", 1.0))
    rows = spark.createDataFrame([(1, *r, y) for r, y in zip(rows.itertuples(index=False), [None, None, None, 100.0, 100.0, None, None, None], strict=True)], f"window int, {segment.LINE}, box_y1 double")
    got = segment.class_lines(rows).orderBy("y0").toPandas()
    assert got["kind"].tolist() == ["orphan", "headword", "sense", "feature_title", "collocation_line", "collocation_line", "sense", "xref"]
    assert got["entry_no"].tolist() == [0, 1, 1, 1, 1, 1, 1, 1]


def test_ocr_entries_to_tables(spark):
    rows = lines((0, 0, 0, 90, "re•sist2 /rɪˈzɪst/ v [T]", 0.9), (0, 20, 0, 90, "1 to oppose something 抵抗；反对 | resist change 抵制改变", 0.8), (0, 40, 0, 90, "2 informal to stay 忍住", 1.0), (0, 60, 0, 90, "give in phr v 1 to stop 屈服", 1.0))
    df = spark.createDataFrame(rows).withColumn("window", F.lit(1))
    boxes = spark.createDataFrame([], "page int, box_no int, x0 double, y0 double, x1 double, y1 double")
    got = {r.headword_key: r for r in ocr_entries.parse_lines(df, boxes, [1]).collect()}
    assert set(got) == {"resist", "give in"}
    r = got["resist"]
    assert (r.homograph, r.pos, r.ipa_raw, r.complete, r.id) == (2, "v", "rɪˈzɪst", True, "p0001-c0-y0000-000")
    assert [(s.sense_no, s.definition_en, s.definition_zh) for s in r.senses] == [("1", "to oppose something", "抵抗；反对"), ("2", "to stay", "忍住")]
    assert [(c.phrase_display, c.explanation_zh) for c in r.collocations] == [("resist change", "抵制改变")]
    tables = ocr_entries.store_tables(ocr_entries.parse_lines(df, boxes, [1]))
    assert tables["senses"].count() == 3 and {k.qkey for k in tables["lookup"].collect()} == {"resist", "resist change", "give in"}
    asked = spark.createDataFrame([(1, "Resist"), (2, "resist change"), (3, "none")], "qid int, text string")
    assert {(x.qid, x.matched_as) for x in ocr_entries.store_lookup(asked, tables["lookup"]).collect()} == {(1, "headword"), (2, "headword")}


def test_html_text_and_links(spark):
    page = "<html><head><script>var t='</p>';</script></head><body><p>a <b>bold<p>next<br>line</p><div class='ad big'>no</div><a href='/x'>x</a><a href='/x'>x</a><a href='/y'> </a>&amp;</body>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r[0] for r in df.select(html.clean_text(F.col("h"), {"ad"})).collect()] == ["a bold\nnext\nline\nxx &", ""]
    assert [[tuple(x) for x in r[0]] for r in df.select(html.cross_refs(F.col("h"))).collect()] == [[("x", "/x")], []]


def test_deep_pages(spark):
    deep = "<div>" * 100_000 + "<a href='/z'>end</a>"
    df = spark.createDataFrame([(deep,)], "h string")
    row = df.select(html.clean_text(F.col("h")).alias("t"), html.cross_refs(F.col("h")).alias("r")).first()
    assert row.t == "end" and [tuple(x) for x in row.r] == [("end", "/z")]
    pages, _ = records.split_links(spark.createDataFrame([("k", deep, 0)], "key string, value string, ord long"))
    assert [r.record_kind for r in records.parse_records(pages).collect()] == ["error"]


RECORD = """<div class="entry"><span class="hwd">take</span><span class="pron">teɪk</span><span class="pasttense">took</span><span class="pos">verb</span>
<span class="sense"><span class="sensenum">1</span><span class="def"><en>to move</en> <tran>拿</tran></span><span class="propform">take something into account</span></span>
<span class="sense"><span class="def"> - </span></span><div class="thesbox"><span class="hwd">other</span></div>
<span class="phrvbentry"><span class="phrvbhwd">take off</span><span class="sense"><span class="def">to leave</span></span></span>
<span class="runon"><span class="deriv">taker</span><span class="pos">noun</span></span></div>"""


def test_records(spark):
    rows = [("take", RECORD, 0), ("took", "\ufeff@@@LINK=take\r\n\x00", 1), ("faq", "<p class='dict-faq'>help</p>", 2), ("see", "<div class='entry'><b class='hwd'>see</b><a class='crossref'>take</a></div>", 3), ("taker", RECORD, 4), ("bad", "<p>x", 5)]
    pages, links = records.split_links(spark.createDataFrame(rows, "key string, value string, ord long"))
    assert [tuple(r) for r in links.collect()] == [("took", "take", 1)]
    got = records.parse_records(pages).collect()
    by = {(r.key, r.kind): r for r in got}
    word, verb = by["take", "word"], by["take", "phrasal_verb"]
    assert word.record_kind == "converted" and verb.parent.id == word.id and [tuple(f) for f in word.inflections] == [("past", "took")]
    norms = {(p.norm, p.match) for p in word.postings}
    assert {("take", "headword"), ("took", "inflection"), ("take into account", "phrase_pattern")} <= norms
    tree = json.loads(word.pos_groups)[0]["senses"]
    assert [(s["definition"]["en"], s["definition"]["zh"]) for s in tree] == [("to move", "拿"), (None, None)]
    assert by["faq", None].record_kind == "excluded_aux" and by["see", "see_also"].record_kind == "converted_crossref" and by["bad", None].record_kind == "error"
    assert by["taker", "derived"].record_kind == "converted_derived_locator" and by["taker", "word"].postings == []
    assert ("taker", "derived_locator") in {(p.norm, p.match) for p in by["taker", "derived"].postings}


def test_typed_sample(spark):
    rows = spark.createDataFrame([(f"k{i:02}", ["a"] if i < 3 else ["a", "b"] if i < 6 else []) for i in range(30)], "key string, types array<string>")
    got = audit.typed_sample(rows, ["a", "b"], "key", "s").collect()
    assert len(got) == 20 == len({r.key for r in got})
    by = {t: [r.key for r in got if r.sample_type == t] for t in ("a", "b", "other")}
    assert len(by["a"]) == len(by["b"]) == 2 and all("k03" <= k <= "k05" for k in by["b"])
    assert sorted(map(str, got)) == sorted(map(str, audit.typed_sample(rows.repartition(7), ["a", "b"], "key", "s").collect()))


def test_store_round_trip(spark, tmp_path):
    lookup = spark.createDataFrame([("resist", "e1", "headword")], "qkey string, entry_id string, kind string")
    ocr_entries.write_store({"lookup": lookup}, f"file://{tmp_path}/store")
    assert spark.read.parquet(f"file://{tmp_path}/store/lookup").where("qkey = 'resist'").count() == 1
