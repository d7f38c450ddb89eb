"""Word lists in other shapes, each as (word, pronounced, defined): CSV, TEI XML, JSON lines; and archives on the driver."""

from __future__ import annotations

import hashlib
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.textnorm import fold


def csv_words(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header (a byte order mark is dropped): columns word, phonetic, translation."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)) if c in rows.columns else F.lit(False)
    return rows.select(fold(F.col("word"), "cli").alias("word"), has("phonetic").alias("pronounced"), has("translation").alias("defined"))


#: What is read of a TEI entry; other elements are skipped by the parser.
TEI = "form array<struct<orth:array<string>,pron:array<string>>>, sense array<struct<cit:array<struct<_type:string,quote:array<string>>>>>"


def tei_words(spark: SparkSession, path: str) -> DataFrame:
    """TEI XML: one row an ``entry``; a word for each orth."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(TEI).load(path)
    pron = F.exists("form", lambda f: F.size(f["pron"]) > 0)
    cits = F.flatten(F.transform(F.filter("sense", lambda s: s["cit"].isNotNull()), lambda s: s["cit"]))
    made = F.exists(cits, lambda c: (c["_type"] == "trans") & (F.size(c["quote"]) > 0))
    words = F.flatten(F.transform(F.filter("form", lambda f: f["orth"].isNotNull()), lambda f: f["orth"]))
    rows = rows.select(F.explode(words).alias("w"), F.coalesce(pron, F.lit(False)).alias("pronounced"), F.coalesce(made, F.lit(False)).alias("defined"))
    return rows.select(fold(F.col("w"), "cli").alias("word"), "pronounced", "defined")


JSONL = "word string, sounds array<struct<ipa:string>>, senses array<struct<glosses:array<string>>>"


def jsonl_words(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with nested sounds and senses; a damaged line stops the read."""
    rows = spark.read.schema(JSONL).option("mode", "FAILFAST").json(path)
    pron = F.exists("sounds", lambda s: F.coalesce(s["ipa"] != "", F.lit(False)))
    made = F.exists("senses", lambda s: F.coalesce(F.size(s["glosses"]) > 0, F.lit(False)))
    return rows.select(fold(F.col("word"), "cli").alias("word"), F.coalesce(pron, F.lit(False)).alias("pronounced"), F.coalesce(made, F.lit(False)).alias("defined"))


def unpack_tar(path: str, suffix: str, to: str) -> tuple[str, str]:
    """The first member of a (compressed) tar with the suffix, unpacked on the driver: its path and the archive's SHA-256."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while chunk := file.read(1 << 20):
            digest.update(chunk)
    with tarfile.open(path) as archive:
        member = next(m for m in archive.getmembers() if m.isfile() and m.name.endswith(suffix))
        with archive.extractfile(member) as source, open(to, "wb") as out:
            while chunk := source.read(1 << 20):
                out.write(chunk)
    return to, digest.hexdigest()
