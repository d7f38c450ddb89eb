"""Conversion end to end, reports, rendering, MDX and other sources, resumable ingest."""

import json
import lzma
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F
from test_library import MANIFEST, as_json, frames, pack
from test_operators import RECORD

from quillspark.functions import render
from quillspark.operators import senses
from quillspark.plans import convert, index, verify
from quillspark.sources import datasets, mdx, packs
from quillspark.streaming.ingest import process_new_files

ROWS = [("take", RECORD), ("taker", RECORD), ("took", "@@@LINK=take"), ("Took", "@@@LINK=took#x"), ("TOOK!", "@@@LINK=Tooked"), ("tooked", "@@@LINK=TOOK#1"), ("a", "@@@LINK=b"), ("b", "@@@LINK=a"), ("lost", "@@@LINK=nowhere"), ("TAKE off!", "@@@LINK=TAKE"), ("faq", "<p class='dict-faq'>?</p>"), ("took", "@@@LINK=take")]


@pytest.fixture(scope="module")
def done(spark):
    return convert.convert(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(ROWS)], "key string, value string, ord long"))


def test_every_record_has_one_ledger_row(done):
    ledger = {(r.ord, r.key): r for r in done.ledger.collect()}
    assert len(ledger) == len(ROWS)
    status = {k: [r.status for (_, key), r in sorted(ledger.items()) if key == k] for k in dict(ROWS)}
    assert status["take"] == ["converted"] and status["taker"] == ["converted_derived_locator"] and status["faq"] == ["excluded_aux"]
    assert status["took"] == ["alias_mapped"] * 2 and status["Took"] == ["alias_unresolved"] and status["TOOK!"] == ["alias_mapped"] and status["TAKE off!"] == ["alias_mapped"]
    assert status["a"] == status["b"] == ["alias_cycle"] and status["lost"] == ["alias_unresolved"]
    assert {r.reason for r in done.issues.where("key = 'lost'").collect()} == {"missing:nowhere"}


def test_aliases_and_entries(done):
    norms = {(r.norm, r.match) for r in done.postings.collect()}
    assert {("took", "alias"), ("take off!", "alias"), ("take off", "alias"), ("taker", "derived_locator"), ("take", "headword")} <= norms
    counts = {r.name: r.n for r in convert.counts(done).collect()}
    assert counts["alias_mapped"] == 4 and counts["alias_cycle"] == 2 and counts["ledger_rows"] == len(ROWS) and counts["senses_bilingual"] >= 1


def test_rendering(spark, done):
    word = done.entries.where("headword = 'take' AND kind = 'word'").limit(1)
    text = render.rendered(word, senses.flat_senses(word)).first().text
    assert text.split("\n")[:2] == ["take [word]", "  1. 拿 / to move"]
    answers = spark.createDataFrame([(1, 1, "take"), (1, 2, "taker"), (1, 3, "take")], "qid int, place int, headword string")
    assert [r.primary for r in render.primary_and_related(answers).orderBy("place").collect()] == [True, False, True]


def test_pack_report_collects_all(spark, tmp_path):
    pack(spark, tmp_path / "good.zip")
    assert verify.pack_report(packs.read_zip(spark, f"file://{tmp_path}/good.zip")) == {"ok": True, "errors": [], "error_count": 0, "by_class": {}, "entries": 2, "lookup_keys": 2}
    entries, lookup = frames(spark, entry="none", parent="gone")
    more = lookup.unionByName(lookup)
    packs.write_pack(as_json(entries.unionByName(entries.limit(1))), more, MANIFEST, str(tmp_path / "bad.zip"))
    report = verify.pack_report(packs.read_zip(spark, f"file://{tmp_path}/bad.zip"))
    assert not report["ok"] and report["by_class"] == {"duplicate_id": 1, "duplicate_norm": 2, "missing_entry": 2, "missing_parent": 1}


def test_required_words_and_markdown(spark, done):
    postings = index.with_head_keys(done.postings, "cli")
    words = spark.createDataFrame([(1, "took"), (2, "absent")], "qid long, text string")
    rows = {r.text: r for r in verify.required_words(words, postings, done.entries).collect()}
    assert rows["took"].hits >= 1 and rows["took"].top[0].headword == "take" and rows["absent"].hits == 0
    assert verify.markdown([{"a": "x|y", "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| x\\|y |  |"


def test_pairing_counts(spark):
    nodes = spark.createDataFrame([("k", "a", "甲", True), ("k", "b", None, False), ("m", None, "乙", True)], "key string, en string, zh string, has_zh_node boolean")
    assert tuple(convert.pairing_counts(nodes).first()) == (3, 2, 1, 1, 2, 1)


def make_mdx(path, records, per_block=2):
    """A version 2 file with plain and zlib blocks."""
    q = lambda *n: b"".join(struct.pack(">Q", x) for x in n)

    def block(data, squeeze):
        return (b"\2\0\0\0" if squeeze else b"\0\0\0\0") + struct.pack(">I", zlib.adler32(data)) + (zlib.compress(data) if squeeze else data)

    bodies = [v.encode() + b"\0" for _, v in records]
    starts = [sum(map(len, bodies[:i])) for i in range(len(bodies))]
    keys = b"".join(q(s) + k.encode() + b"\0" for s, (k, _) in zip(starts, records, strict=True))
    kb = block(keys, True)
    first, last = records[0][0].encode(), records[-1][0].encode()
    info = q(len(records)) + struct.pack(">H", len(first)) + first + b"\0" + struct.pack(">H", len(last)) + last + b"\0" + q(len(kb), len(keys))
    ib = block(info, True)
    head = q(1, len(records), len(info), len(ib), len(kb))
    datas = [b"".join(bodies[i : i + per_block]) for i in range(0, len(bodies), per_block)]
    rbs = [block(d, i % 2 == 0) for i, d in enumerate(datas)]
    table = b"".join(q(len(b), len(d)) for b, d in zip(rbs, datas, strict=True))
    header = '<Dictionary GeneratedByEngineVersion="2.0" Encrypted="0" Encoding="UTF-8" Title="T &amp; U"/>\r\n\0'.encode("utf-16-le")
    with open(path, "wb") as f:
        f.write(struct.pack(">I", len(header)) + header + struct.pack("<I", zlib.adler32(header)) + head + struct.pack(">I", zlib.adler32(head)) + ib + kb)
        f.write(q(len(rbs), len(records), len(table), sum(map(len, rbs))) + table + b"".join(rbs))


def test_mdx(spark, tmp_path):
    path = str(tmp_path / "d.mdx")
    make_mdx(path, [("a", "<p>é</p>"), ("b", "@@@LINK=a\r\n"), ("c", "\ufeff<p>c</p>"), ("d", "x"), ("e", "y")])
    mdx.register(spark)
    rows = spark.read.format("mdx").load(path).orderBy("ord").collect()
    assert [(r.key, r.is_link, r.target) for r in rows] == [("a", False, None), ("b", True, "a"), ("c", False, None), ("d", False, None), ("e", False, None)]
    assert rows[0].value == "<p>é</p>"
    info = mdx.report(path)
    assert info["records"] == 5 and info["block_kinds"] == {"zlib": 2, "none": 1} and info["replacement_chars"] == 0 and info["header"]["Title"] == "T & U" and info["sampled_blocks"] == 3
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises((mdx.MdxError, zlib.error)):
        mdx.report(path)


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.csv").write_text('\ufeffword,phonetic,translation\nRun,rʌn,"跑\n走"\nset,,\n', encoding="utf-8")
    assert sorted(map(tuple, datasets.csv_words(spark, f"file://{tmp_path}/w.csv").collect())) == [("run", True, True), ("set", False, False)]
    tei = "<TEI><body><entry><form><orth>Run</orth><pron>x</pron></form><sense><cit type='trans'><quote>跑</quote></cit></sense></entry><entry><form><orth>set</orth></form></entry></body></TEI>"
    with tarfile.open(tmp_path / "d.tar.xz", "w:xz") as archive:
        (tmp_path / "d.tei").write_text(tei, encoding="utf-8")
        archive.add(tmp_path / "d.tei", "x/d.tei")
    assert lzma.open(tmp_path / "d.tar.xz").read(1)
    path, digest = datasets.unpack_tar(str(tmp_path / "d.tar.xz"), ".tei", str(tmp_path / "out.xml"))
    assert len(digest) == 64 and sorted(map(tuple, datasets.tei_words(spark, f"file://{path}").collect())) == [("run", True, True), ("set", False, False)]
    (tmp_path / "k.jsonl").write_text("\n".join(json.dumps(x) for x in [{"word": "Go", "sounds": [{"ipa": "g"}], "senses": [{"glosses": ["x"]}]}, {"word": "no", "senses": [{}]}]), encoding="utf-8")
    assert sorted(map(tuple, datasets.jsonl_words(spark, f"file://{tmp_path}/k.jsonl").collect())) == [("go", True, True), ("no", False, False)]


def test_ingest_resumes(spark, tmp_path):
    work = lambda df: df.withColumn("double", F.col("id") * 2)
    at = [f"file://{tmp_path}/{x}" for x in ("in", "out", "check")]
    spark.range(5).coalesce(1).write.parquet(at[0])
    assert process_new_files(spark, at[0], "id long", work, at[1], at[2]) == 1
    assert process_new_files(spark, at[0], "id long", work, at[1], at[2]) == 0
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(at[0])
    assert process_new_files(spark, at[0], "id long", work, at[1], at[2]) == 1
    assert spark.read.parquet(at[1]).selectExpr("sum(double)").first()[0] == 56
