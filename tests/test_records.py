"""Fields of records, on pages written for these tests: anchors, glosses, variants, references, phrases."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.plans import convert
from quillspark.plans.library import Library
from quillspark.sources import html, packs, records

BRIM = """<a name="x_brim_1"></a><div class="entry"><span class="entryhead"><span class="hwd">brim</span><span class="homnum">2</span>
<span class="proncodes">/<span class="pron">brɪ<i>m</i></span><span class="amevarpron">$ brim</span>/</span><span class="level">●●○</span><span class="freq">S3</span><span class="freq">W2</span>
<span class="pos">noun, verb</span><span class="gram">[countable; usually singular]</span><span class="geo">British English</span><span class="pluralform">brims</span></span>
<div class="at-link"><span class="entry"><span class="hwd">noise</span><span class="pos">noise</span></span></div>
<a name="x_brim_s1"></a><span class="sense"><span class="sensenum">1.</span><span class="signpost"><SIGNEN>edge</SIGNEN><SIGN>边</SIGN></span><span class="gram">[uncountable]</span><span class="registerlab">informal</span>
<span class="lexunit">to the brim</span><span class="variant">also <span class="lexvar">up to the brim</span></span>
<span class="def"><en>12</en><tran>十二</tran></span>
<a href="entry://rim"><span class="refhwd">at rim</span></a></span>
<span class="sense"><span class="sensenum">2</span>
<span class="subsense"><span class="sensenum">a</span><span class="def"><en>an abbreviation of</en></span><span class="fullform">broad rim</span><span class="subsense"><span class="def"><en>deepest</en></span></span></span>
<span class="def"><span class="gramexa"><span class="propformprep">brim of</span><span class="example">the brim of a hat</span></span><span class="colloexa"><span class="collo">wide/narrow brim</span></span></span></span>
<span class="collobox"><span class="collocate"><span class="colloc">full brim</span><span class="collgloss">(= all of it)</span></span></span>
<span class="phrvbentry"><span class="phrvbhwd">brim↔over</span><span class="registerlab">literary</span><span class="sense"><span class="def"><en>to spill</en></span><span class="propform">brim over with something</span></span></span>
<span class="runon"><span class="deriv">—brimful</span><span class="proncodes">/x/</span><span class="pos">adjective</span></span>
<span class="tail"><a href="entry://edge"><span class="refhwd">edge</span><span class="refhomnum">1</span><span class="refsensenum">(3)</span></a></span></div>"""
DOT = '<span class="entry"><span class="hwd">B.</span><span class="sense"><span class="def"><en>the written abbreviation of</en></span><span class="fullform">base</span></span><span class="sense"><span class="def"><en>short for <span class="fullform">bay</span></en></span></span></span>'
ODD = [None, "", "<", "<span class='entry'>", "<span class='entry'><span class='hwd'> </span></span>", "<div class='dict-faq-about'>?</div>", "<span class='entry'><span class='hwd'>x</span>" + "<span class='sense'>" + "<span class='subsense'>" * 5_000, "<div class='c'>" * 20_000]


def parse(key, page):
    return {(e["kind"], e["headword"]): e for e in records.Record(key, page).entries()}


@pytest.fixture(scope="module")
def brim():
    return parse("brim", BRIM)


def test_head(brim):
    word = brim["word", "brim"]
    assert word["id"] == "x_brim_1" and word["homograph"] == 2 and word["groups"][0]["pos"] == ["noun", "verb"]
    assert word["groups"][0]["grammar"] == ["countable", "usually singular"] and word["groups"][0]["labels"] == [{"type": "geo", "value": "British English", "scope": "pos"}]
    assert [(p["ipa"], p["accent"]) for p in word["pronunciations"]] == [("brɪm", "br"), ("brim", "us")]
    assert word["frequency"] == {"stars": "●●○", "spoken": "S3", "written": "W2"} and word["inflections"] == [{"type": "plural", "form": "brims"}]


def test_senses(brim):
    one, two = brim["word", "brim"]["groups"][0]["senses"]
    assert one["id"] == "x_brim_s1" and one["number"] == "1" and one["signpost"] == {"en": "edge", "zh": "边"} and one["definition"] == {"en": "12", "zh": "十二"}
    assert one["grammar"] == ["uncountable"] and one["labels"] == [{"type": "register", "value": "informal", "scope": "sense"}] and one["patterns"] == ["up to the brim"]
    assert one["phrases"] == [{"id": "x_brim_s1#lu1", "type": "lexical_unit", "text": "to the brim", "definition": one["definition"], "labels": [], "sense_id": "x_brim_s1", "patterns": []}]
    assert one["cross_refs"] == [{"text": "rim", "href": "entry://rim", "homograph": None, "sense": None, "relation": "see"}]
    # the shell of examples is no gloss, its pattern is one
    assert two["id"] == "x_brim_1#s2" and two["definition"] == {"en": None, "zh": None} and two["patterns"] == ["brim of"]
    assert [s["id"] for s in records.walk_tree([two])] == ["x_brim_1#s2", "x_brim_1#s2.1", "x_brim_1#s2.1.1"]
    assert two["senses"][0]["definition"]["en"] == "an abbreviation of broad rim" and two["senses"][0]["senses"][0]["definition"]["en"] == "deepest"


def test_children_references_and_phrases(brim):
    word, verb, derived = brim["word", "brim"], brim["phrasal_verb", "brim ↔ over"], brim["derived", "brimful"]
    assert word["cross_refs"] == [{"text": "edge", "href": "entry://edge", "homograph": 1, "sense": "3", "relation": "see"}]
    assert [(p["id"], p["text"], p["definition"]["en"]) for p in word["phrases"]] == [("x_brim_1#col1", "full brim", "all of it")]
    assert verb["id"] == "x_brim_1#pv:brim-over" and verb["groups"][0]["labels"] == [{"type": "register", "value": "literary", "scope": "phrase"}]
    assert verb["parent"] == {"id": "x_brim_1", "headword": "brim", "relation": "phrasal_verb"} and derived["parent"]["relation"] == "runon"
    assert [(p["ipa"], p["accent"]) for p in derived["pronunciations"]] == [("x", "unspecified")] and derived["notes"] == ["no independent definition; run-on of brim"]
    norms = {(h[0], h[2]) for h in records.postings(word, [])} | {(h[0], h[2]) for h in records.postings(verb, [])}
    assert {("to the brim", "phrase"), ("up to the brim", "phrase_pattern"), ("brim of", "phrase_pattern"), ("full brim", "collocation"), ("brims", "inflection"), ("brim over", "phrasal_verb"), ("brim over with", "phrase_pattern")} <= norms


def test_full_forms_and_periods():
    entry = parse("B.", DOT)["word", "B."]
    assert [s["definition"]["en"] for s in entry["groups"][0]["senses"]] == ["the written abbreviation of base", "short for bay"]
    assert [h[0] for h in records.postings(entry, [])] == ["b.", "b"]


def test_odd_pages(spark):
    rows = spark.createDataFrame([("k", v, i) for i, v in enumerate(ODD)], "key string, value string, ord long")
    got = {r.ord: (r.record_kind, r.issues) for r in records.parse_records(rows).collect()}
    error = ("error", ["no_entry_node"])
    assert [got[i] for i in range(len(ODD))] == [error, error, error, error, ("error", ["missing_headword"]), ("excluded_aux", ["front_matter_not_headword"]), ("error", ["too_deep"]), error]


def test_converted_pages_can_be_packed_and_imported(spark, tmp_path):
    pages = [("brim", BRIM), ("brimful", BRIM), ("B.", DOT), ("brims", "@@@LINK=brim")]
    done = convert.convert(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pages)], "key string, value string, ord long"))
    entries = {r.id: r for r in done.entries.collect()}
    assert entries["x_brim_1"].source_keys == ["brim"] and entries["x_brim_1#deriv:brimful"].source_keys == ["brim", "brimful"]
    assert json.loads(entries["x_brim_1"].pos_groups)[0]["senses"][0]["labels"][0]["value"] == "informal"
    manifest = {"format": "quill-dict-pack", "format_version": "1.0", "pack_id": "b", "source": {"name": "B"}}
    packs.write_pack(*convert.pack_tables(done), manifest, str(tmp_path / "b.zip"))
    library = Library(spark, f"file://{tmp_path}/lib")
    assert library.import_pack(f"file://{tmp_path}/b.zip")["entries"] == len(entries)
    asked = spark.createDataFrame([(1, "brims"), (2, "B.")], "qid long, text string")
    assert {(r.qid, r.entry.headword) for r in library.lookup(asked).collect()} >= {(1, "brim"), (2, "B.")}


def test_pages_of_one_partition_are_parsed_by_many_tasks(spark):
    rows = spark.range(400).selectExpr("CAST(id AS STRING) AS key", "concat('<div class=\"entry\"><span class=\"hwd\">w', id, '</span></div>') AS value", "id AS ord").coalesce(1)
    parsed = records.parse_records(rows)
    assert sorted(r.ord for r in parsed.collect()) == list(range(400))
    per_task = [r["count"] for r in parsed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 4 and max(per_task) <= 200


def test_named_columns_are_those_of_all(spark):
    rows = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate([("brim", BRIM), ("brimful", BRIM), ("B.", DOT), (None, None)])], "key string, value string, ord int")
    whole, some = records.parse_records(rows), records.parse_records(rows, ["parent", "id"])
    assert some.columns == ["key", "ord", "id", "parent"] and dict(some.dtypes)["ord"] == "int"
    assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select(*some.columns).collect()))


def dump(node):
    texts = [c if isinstance(c, str) else dump(c) for c in node.children]
    return [node.tag, node.attrs, sorted(node.classes), texts]


PLAIN = [BRIM, DOT, "", "x", "<P CLASS='a  b'>1 &amp; 2<p>3<li>4<ul><li>5<li>6</ul></x>", "<td>a<tr>b<br/>c<img src=\"i\"><b class='' >d</b\n>", "<a id='1' id=\"2\">&nbsp</a>", "a > b", "</p></p><i></b></i>"]
OTHER = ["<a href='?x=1&y=2'>", "<b", "a < b", "<!-- c --><p>", "<script>a<b></script>", "<title>a<b></title>", "<x-y>", "<b c>", "<b c=d>", "<b c='>'>"]


@pytest.mark.parametrize("page", PLAIN + OTHER)
def test_trees_of_plain_pages_are_the_parsers(page, monkeypatch):
    quick = html._plain_tree(page) if html._plain.fullmatch(page) else None
    assert (quick is not None) == (page in PLAIN)
    got = dump(html.tree(page))
    monkeypatch.setattr(html, "_plain_tree", lambda page: None)
    assert got == dump(html.tree(page))
