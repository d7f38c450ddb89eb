"""Dictionary packs: a ZIP (or folder) of manifest.json, entries.jsonl and lookup.jsonl.

The bytes come through Spark's binaryFile source, so any file system Spark reads
will do. A ZIP cannot be split: one task opens it, checks it, and hands out its
lines, numbered; everything after that is distributed.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The members of a pack and the bounds on sizes.
MEMBERS = ["manifest.json", "entries.jsonl", "lookup.jsonl"]
MOST_ZIP, MOST_MEMBER, MOST_TOTAL, MOST_MANIFEST, MOST_LINE = 120 << 20, 300 << 20, 450 << 20, 1 << 20, 4 << 20


class PackError(ValueError):
    """A pack that cannot be read."""


def open_members(data: bytes) -> dict[str, bytes]:
    """The three members of a pack's ZIP, after all bounds are checked on the directory alone."""
    if len(data) > MOST_ZIP:
        raise PackError("pack too large")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = archive.infolist()
    except (zipfile.BadZipFile, NotImplementedError) as error:
        raise PackError("no ZIP directory") from error
    if sorted(i.filename for i in infos) != sorted(MEMBERS):
        raise PackError("a pack holds exactly " + ", ".join(MEMBERS))
    if any(i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for i in infos):
        raise PackError("encrypted member or unknown method")
    if any(i.file_size > (MOST_MANIFEST if i.filename == MEMBERS[0] else MOST_MEMBER) for i in infos) or sum(i.file_size for i in infos) > MOST_TOTAL:
        raise PackError("member too large")
    return {i.filename: _member(data, archive, i) for i in infos}


def _member(data: bytes, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """One member; inflating stops as soon as it passes the declared length."""
    head = data[info.header_offset : info.header_offset + 30]
    if head[:4] != b"PK\x03\x04":
        raise PackError("local header damaged")
    start = info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    raw = data[start : start + info.compress_size]
    if start + info.compress_size > archive.start_dir:
        raise PackError("member out of range")
    if info.compress_type == zipfile.ZIP_DEFLATED:
        inflate = zlib.decompressobj(-15)
        try:
            raw = inflate.decompress(raw, info.file_size + 1)
        except zlib.error as error:
            raise PackError("member damaged") from error
    if len(raw) != info.file_size or zlib.crc32(raw) != info.CRC:
        raise PackError("member length or checksum differs")
    return raw


def numbered_lines(data: bytes) -> Iterator[tuple[int, str]]:
    """(number from 1, text) of the lines that are not blank; a last line without an end counts."""
    for number, line in enumerate(data.split(b"\n"), 1):
        if len(line) > MOST_LINE:
            raise PackError(f"line {number} too long")
        try:
            text = line.decode("utf-8")
        except UnicodeDecodeError as error:
            raise PackError(f"line {number} is not UTF-8") from error
        if text.strip():
            yield number, text


def _unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for data in part["content"]:
            for name, body in open_members(bytes(data)).items():
                if name == MEMBERS[0]:
                    yield pd.DataFrame({"member": [name], "line_no": [1], "line": [body.decode("utf-8")], "sha256": [hashlib.sha256(body).hexdigest()]})
                    continue
                digest, rows = hashlib.sha256(body).hexdigest(), list(numbered_lines(body))
                for at in range(0, len(rows), 5000):
                    some = rows[at : at + 5000]
                    yield pd.DataFrame({"member": name, "line_no": [n for n, _ in some], "line": [x for _, x in some], "sha256": digest})


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(member, line_no, line, sha256 of the member) of a pack's ZIP."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unpack, "member string, line_no long, line string, sha256 string")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The same rows of an unpacked pack. Lines are numbered within Spark's splits in file order."""
    rows = None
    for name in MEMBERS:
        whole = name == MEMBERS[0]
        text = spark.read.text(f"{path}/{name}", wholetext=whole).withColumn("line_no", F.monotonically_increasing_id() + 1)
        file = spark.read.format("binaryFile").load(f"{path}/{name}").select(F.sha2("content", 256).alias("sha256"))
        part = text.where(F.trim("value") != "").crossJoin(F.broadcast(file)).select(F.lit(name).alias("member"), "line_no", F.col("value").alias("line"), "sha256")  # one row a file
        rows = part if rows is None else rows.unionByName(part)
    return rows


def manifest_of(lines: DataFrame) -> dict:
    """The manifest: one small object, which gates the import on the driver."""
    row = lines.where(F.col("member") == MEMBERS[0]).first()
    if row is None:
        raise PackError("no manifest")
    return json.loads(row["line"])


def checksum_errors(lines: DataFrame, manifest: dict) -> list[str]:
    """Members whose SHA-256 is absent from the manifest, malformed, or another."""
    actual = {r["member"]: r["sha256"] for r in lines.where(F.col("member") != MEMBERS[0]).groupBy("member").agg(F.first("sha256").alias("sha256")).collect()}  # two rows
    declared = manifest.get("checksums") or {}
    return [name for name in MEMBERS[1:] if str(declared.get(name, "")).lower() != actual.get(name, hashlib.sha256(b"").hexdigest())]


def parsed(lines: DataFrame, member: str, schema: str) -> DataFrame:
    """Rows of a member by a schema; a line that is not JSON stops the read and names its number."""
    rows = lines.where(F.col("member") == member).select("line_no", F.from_json("line", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    checked = F.when(F.col("r.__bad").isNotNull(), F.raise_error(F.concat(F.lit(f"{member} line "), F.col("line_no"), F.lit(" is damaged")))).otherwise(F.col("line_no"))
    return rows.select(checked.cast("long").alias("line_no"), "r.*").drop("__bad")


def json_lines(rows: DataFrame, order: str) -> DataFrame:
    """Compact JSON of each row, sorted; null fields are written, other scripts are not escaped."""
    return rows.orderBy(order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_pack(entries: DataFrame, lookup: DataFrame, manifest: dict, path: str) -> dict:
    """A pack's ZIP at a local path. A pack is bounded by MOST_TOTAL, so its lines may pass through the driver."""
    bodies = {}
    for name, rows in ((MEMBERS[1], json_lines(entries, "id")), (MEMBERS[2], json_lines(lookup, "norm"))):
        out, n = io.BytesIO(), 0
        for row in rows.toLocalIterator():
            out.write(row["value"].encode() + b"\n")
            n += 1
            if out.tell() > MOST_MEMBER:
                raise PackError("member too large")
        bodies[name] = out.getvalue(), n
    manifest = manifest | {
        "files": MEMBERS,
        "counts": manifest.get("counts", {}) | {"entries": bodies[MEMBERS[1]][1], "lookup_keys": bodies[MEMBERS[2]][1]},
        "checksums": {name: hashlib.sha256(body).hexdigest() for name, (body, _) in bodies.items()},
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(MEMBERS[0], json.dumps(manifest, ensure_ascii=False, indent=2))
        for name, (body, _) in bodies.items():
            archive.writestr(name, body)
    return manifest


def write_jsonl(rows: DataFrame, order: str, path: str) -> None:
    """Rows as sorted JSON lines; part files follow one another in the order."""
    json_lines(rows, order).write.mode("overwrite").text(path)


class PackCache:
    """Lines of packs, kept as long as the file stays the same (path and time of change)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: dict[str, tuple[int, DataFrame]] = {}

    def lines(self, path: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        changed = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()
        if path in self.kept and self.kept[path][0] == changed:
            return self.kept[path][1]
        if path in self.kept:
            self.kept[path][1].unpersist()
        self.kept[path] = changed, read_zip(self.spark, path).cache()
        return self.kept[path][1]
