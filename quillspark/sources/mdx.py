"""MDX 1.x/2.x dictionary files: header, keys, records, and an integrity report of record blocks.

The layout is public: a UTF-16 XML header, a table of key blocks, a table of
record blocks; blocks are stored plain or with zlib, and carry an Adler-32. The reader
is a Python data source: the driver reads the tables of blocks, every task inflates its own.
Encrypted files and LZO blocks are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {b"\0\0\0\0": "none", b"\1\0\0\0": "lzo", b"\2\0\0\0": "zlib"}
SCHEMA = "key string, value string, is_link boolean, target string, ord long"


class MdxError(ValueError):
    pass


def inflate(block: bytes, size: int) -> bytes:
    kind = KINDS.get(block[:4])
    if kind == "none":
        data = block[8:]
    elif kind == "zlib":
        data = zlib.decompress(block[8:])
    else:
        raise MdxError(f"block kind {kind or block[:4].hex()}")
    if len(data) != size or zlib.adler32(data) != struct.unpack(">I", block[4:8])[0]:
        raise MdxError("block length or Adler-32 differs")
    return data


@dataclass
class Index:
    """Where everything is."""

    header: dict[str, str]
    encoding: str
    keys: list[tuple[int, str]] = field(default_factory=list)
    blocks: list[tuple[int, int, int]] = field(default_factory=list)  # offset, stored size, size


def read_index(path: str) -> Index:
    with open(path, "rb") as file:
        raw = file.read(struct.unpack(">I", file.read(4))[0])
        if struct.unpack("<I", file.read(4))[0] != zlib.adler32(raw):
            raise MdxError("header checksum")
        text = raw.decode("utf-16-le").rstrip("\0")
        header = {k: unescape(v) for k, v in re.findall(r'(\w+)="(.*?)"', text, re.S)}
        if header.get("Encrypted", "0") not in ("0", "No", ""):
            raise MdxError("encrypted")
        new = float(header.get("GeneratedByEngineVersion", "2.0")) >= 2
        encoding = {"": "utf-8", "UTF-8": "utf-8", "UTF-16": "utf-16-le", "GBK": "gb18030", "GB2312": "gb18030"}.get(header.get("Encoding", "").upper(), header.get("Encoding", "utf-8"))
        wide = 2 if encoding == "utf-16-le" else 1
        number = lambda data, at=0: struct.unpack_from(">Q" if new else ">I", data, at)[0]
        width = 8 if new else 4
        head = file.read(width * (5 if new else 4))
        if new:
            file.read(4)  # Adler-32 of the five numbers
        n_blocks, info_size, keys_size = number(head), number(head, width * (3 if new else 2)), number(head, width * (4 if new else 3))
        info = file.read(info_size)
        if new:
            info = inflate(info, number(head, width * 2))
        index = Index(header, encoding)
        at, sizes = 0, []
        for _ in range(n_blocks):
            at += width
            for _ in range(2):
                n = struct.unpack_from(">H" if new else ">B", info, at)[0]
                at += (2 if new else 1) + (n + (1 if new else 0)) * wide
            sizes.append((number(info, at), number(info, at + width)))
            at += 2 * width
        stored = file.read(keys_size)
        at = 0
        for packed, size in sizes:
            data, here = inflate(stored[at : at + packed], size), 0
            at += packed
            while here < len(data):
                start, here = number(data, here), here + width
                end = here
                while data[end : end + wide] != b"\0" * wide:
                    end += wide
                index.keys.append((start, data[here:end].decode(encoding, "replace").strip()))
                here = end + wide
        head = file.read(4 * width)
        n_blocks, info_size = number(head), number(head, 2 * width)
        if info_size != 2 * width * n_blocks:
            raise MdxError("record block table")
        info, at = file.read(info_size), file.tell()
        for i in range(n_blocks):
            packed, size = number(info, 2 * width * i), number(info, 2 * width * i + width)
            index.blocks.append((at, packed, size))
            at += packed
    return index


def report(path: str) -> dict:
    """Header and counts; the first, middle and last record block are inflated, checked and scanned for replacement characters."""
    index, kinds, fffd, sampled = read_index(path), {}, 0, 0
    pick = {0, len(index.blocks) // 2, len(index.blocks) - 1}
    with open(path, "rb") as file:
        for i, (at, packed, size) in enumerate(index.blocks):
            file.seek(at)
            kind = KINDS.get(file.read(4), "unknown")
            kinds[kind] = kinds.get(kind, 0) + 1
            if i in pick:
                file.seek(at)
                text = inflate(file.read(packed), size).decode(index.encoding, "replace")
                fffd += text.count("�")
                sampled += size
    return {"header": index.header, "records": len(index.keys), "block_kinds": kinds, "replacement_chars": fffd, "sampled_blocks": len(pick & set(range(len(index.blocks)))), "sampled_bytes": sampled}


@dataclass
class Blocks(InputPartition):
    at: int
    packed: int
    size: int
    first: int
    keys: list[tuple[int, int, str]]  # start and end in the inflated block, key
    encoding: str


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Blocks]:
        index = read_index(self.path)
        starts = [s for s, _ in index.keys] + [sum(b[2] for b in index.blocks)]
        out, base, k = [], 0, 0
        for at, packed, size in index.blocks:
            keys, first = [], k
            while k < len(index.keys) and starts[k] < base + size:
                keys.append((starts[k] - base, min(starts[k + 1], base + size) - base, index.keys[k][1]))
                k += 1
            out.append(Blocks(at, packed, size, first, keys, index.encoding))
            base += size
        return out

    def read(self, part: Blocks) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            file.seek(part.at)
            data = inflate(file.read(part.packed), part.size)
        for n, (start, end, key) in enumerate(part.keys):
            value = data[start:end].decode(part.encoding, "ignore").rstrip("\0")
            plain = value.lstrip("\ufeff").strip()
            link = plain.startswith("@@@LINK=")
            yield key, value, link, plain[8:].strip("\0 \r\n\t") if link else None, part.first + n


class MdxSource(DataSource):
    """``spark.read.format("mdx").load(path)``: SCHEMA rows in the order of the file."""

    @classmethod
    def name(cls) -> str:
        return "mdx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"].removeprefix("file://"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MdxSource)
