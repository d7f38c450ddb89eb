"""Packs and the library: round trip, tampering, activation."""

import io
import json
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillspark.plans.library import ENTRY, LOOKUP, ImportFailed, Library, LibraryBusy
from quillspark.sources import packs


def groups(*ids):
    return json.dumps([{"senses": [{"id": i, "definition": {"en": "x", "zh": None}} for i in ids]}])


def frames(spark, entry="run", sense="run#s1", parent=None):
    entries = [("run", "run", None, "word", None, [("past", "past tense ran")], None, groups("run#s1")), ("run-up", "run up", None, "phrasal_verb", None, None, (parent or "run", "run", "x"), groups("run-up#s1"))]
    lookup = [("run", [(entry, sense, "headword", "run", "run")]), ("run up", [("run-up", None, "headword", "run up", "run up")])]
    return spark.createDataFrame(entries, ENTRY), spark.createDataFrame(lookup, LOOKUP)


MANIFEST = {"format": "quill-dict-pack", "format_version": "1.0", "pack_id": "p1", "source": {"name": "Test"}}


def as_json(entries):
    return entries.withColumn("pos_groups", F.from_json("pos_groups", "array<struct<senses:array<struct<id:string,definition:struct<en:string,zh:string>>>>>"))


def pack(spark, path, **wrong):
    entries, lookup = frames(spark, **wrong)
    return packs.write_pack(as_json(entries), lookup, MANIFEST, str(path))


def test_round_trip_lookup_and_rename(spark, tmp_path):
    pack(spark, tmp_path / "a.zip")
    library = Library(spark, f"file://{tmp_path}/lib")
    assert library.active() is None
    first = library.import_pack(f"file://{tmp_path}/a.zip")
    asked = spark.createDataFrame([(1, "Run."), (2, "ran")], "qid long, text string")
    got = {(r.qid, r.entry_id): (r.match, r.related) for r in library.lookup(asked).collect()}
    assert got == {(1, "run"): ("headword", ["run-up"]), (2, "run"): ("inflection", ["run-up"])}
    library.rename("p1", "  Mine ")
    second = library.import_pack(f"file://{tmp_path}/a.zip")
    assert library.active()["name"] == "Mine" and second["generation"] != first["generation"]
    assert library.generations() == {second["generation"]}
    with pytest.raises(KeyError):
        library.select("other")
    with pytest.raises(ValueError):
        library.rename("p1", " ")


@pytest.mark.parametrize(("wrong", "why"), [({"entry": "none"}, "missing entry"), ({"sense": "none"}, "missing sense"), ({"parent": "none"}, "missing parent")])
def test_bad_references_leave_the_active_pack(spark, tmp_path, wrong, why):
    library = Library(spark, f"file://{tmp_path}/lib")
    pack(spark, tmp_path / "good.zip")
    kept = library.import_pack(f"file://{tmp_path}/good.zip")
    pack(spark, tmp_path / "bad.zip", **wrong)
    with pytest.raises(ImportFailed, match=why):
        library.import_pack(f"file://{tmp_path}/bad.zip")
    assert library.active() == kept and library.generations() == {kept["generation"]}


def test_one_import_at_a_time_and_no_lost_change(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib")
    for n in range(6):
        library.register({"id": f"p{n}", "name": "x", "generation": f"g{n}"})
    (tmp_path / "lib/entries/generation=staging").mkdir(parents=True)
    with library._locked("import"):
        with pytest.raises(LibraryBusy):
            library.import_pack(f"file://{tmp_path}/none.zip")
        with pytest.raises(LibraryBusy):
            library.clean()
    assert library.generations() == {"staging"} == library.clean() and library.generations() == set()
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda n: Library(spark, f"file://{tmp_path}/lib").rename(f"p{n}", f"name {n}"), range(6)))
    assert [p["name"] for p in library.state()["packs"]] == [f"name {n}" for n in range(6)]
    with pytest.raises(KeyError):
        library.rename("none", "x")
    assert not library.unlock("registry") and not library.unlock("import")  # a failure leaves no lock
    (tmp_path / "lib/import.lock").touch()  # of a driver that died
    assert library.unlock("import") and library.clean() == set()


def rewrite(path, change, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path) as old:
        members = {n: old.read(n) for n in old.namelist()}
    change(members)
    with zipfile.ZipFile(path, "w", method) as new:
        for name, body in members.items():
            new.writestr(name, body)


def test_tampering_and_stored_members(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib")
    path = tmp_path / "a.zip"
    pack(spark, path)
    rewrite(path, lambda m: m.update({"entries.jsonl": m["entries.jsonl"].replace(b"past", b"last")}))
    with pytest.raises(ImportFailed, match="entries.jsonl"):
        library.import_pack(f"file://{path}")
    pack(spark, path)
    rewrite(path, lambda m: None, zipfile.ZIP_STORED)
    assert library.import_pack(f"file://{path}")["keys"] == 2
    pack(spark, path)
    rewrite(path, lambda m: m.update({"manifest.json": json.dumps(json.loads(m["manifest.json"]) | {"counts": {"entries": 2, "lookup_keys": 9}}).encode()}))
    with pytest.raises(ImportFailed, match="lookup_keys"):
        library.import_pack(f"file://{path}")


def test_zip_bounds():
    def zipped(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in members:
                z.writestr(name, body)
        return out.getvalue()

    good = zipped(*[(n, b"{}\n") for n in packs.MEMBERS])
    assert set(packs.open_members(good)) == set(packs.MEMBERS)
    for bad in (b"", good[:40], zipped(("../x", b"")), zipped(*[(n, b"") for n in packs.MEMBERS], ("more", b"")), zipped(("manifest.json", b"x" * (packs.MOST_MANIFEST + 1)), ("entries.jsonl", b""), ("lookup.jsonl", b""))):
        with pytest.raises(packs.PackError):
            packs.open_members(bad)
    assert [*packs.numbered_lines("a\n\n é".encode())] == [(1, "a"), (3, " é")]
    with pytest.raises(packs.PackError, match="line 2"):
        [*packs.numbered_lines(b"a\n\xff")]


def test_folder_pack_and_damaged_line(spark, tmp_path):
    path = tmp_path / "a.zip"
    pack(spark, path)
    with zipfile.ZipFile(path) as z:
        z.extractall(tmp_path / "dir")
    lines = packs.read_folder(spark, f"file://{tmp_path}/dir")
    assert packs.checksum_errors(lines, packs.manifest_of(lines)) == []
    assert Library(spark, f"file://{tmp_path}/lib").import_pack(f"file://{tmp_path}/dir", folder=True)["entries"] == 2
    broken = lines.withColumn("line", F.when(F.col("member") == "lookup.jsonl", "{oops").otherwise(F.col("line")))
    with pytest.raises(Exception, match="lookup.jsonl line 1"):
        packs.parsed(broken, "lookup.jsonl", LOOKUP).collect()


def test_cache_follows_the_file(spark, tmp_path):
    import os

    path = tmp_path / "a.zip"
    pack(spark, path)
    cache = packs.PackCache(spark)
    first = cache.lines(f"file://{path}")
    assert cache.lines(f"file://{path}") is first and first.count() == 5
    os.utime(path, (1, 1))
    assert cache.lines(f"file://{path}") is not first


def test_sorted_lines_keep_nulls_and_scripts(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", "中")], "id string, x string")
    packs.write_jsonl(df, "id", f"file://{tmp_path}/out")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/out").collect()] == ['{"id":"a","x":"中"}', '{"id":"b","x":null}']
