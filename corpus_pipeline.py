"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but
the last return the columns of documents. run() writes each stage's result as Parquet in
the shared folder and reads it back for the next one, so that a lost executor never costs more
than a stage. Extra columns of docs pass through the stages that return documents.

Empty tables, nulls and repeated rows: as the operators define them. A document that line dedup leaves without a
line stays as an empty text; all such texts are near-duplicates of one another, so one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_fst, language_id, line_dedup, mixing, simhash
from quillspark.llm.common import Scratch, free_name, row_id
from quillspark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns(docs: DataFrame) -> list[str]:
    """The columns of docs, quoted: a name may hold a dot."""
    return [f"`{c}`" for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those that the classifier rejects go."""
    model = language_id.fit(docs)
    known = language_id.predict(docs, model)
    return known.where(~F.col(known.columns[-1])).select(*columns(docs))  # the last column says whether a text is rejected


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out of the texts; n_chars follows."""
    clean = line_dedup.dedup_lines(docs).select(*columns(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the least doc_id (null last), then the first row."""
    scratch = Scratch(spark)
    row = free_name(docs, "__row")
    whole = scratch.save(docs.withColumn(row, row_id()), "documents")
    groups = simhash.near_groups(whole, row_col=row)
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row_id").alias("c"))
    kept = groups.groupBy("group").agg(F.min(first).alias("first")).select(F.col("first.c").alias(row))
    return whole.join(scratch.save(kept, "kept").hint("merge"), row, "left_semi").select(*columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    scratch = Scratch(spark)
    row, copy = free_name(docs, "__row"), free_name(docs, "__copy")
    whole = scratch.save(docs.withColumn(row, row_id()), "documents")
    copies = mixing.mix(whole, row_col=row).where("copies > 0").select(F.col("row_id").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))
    return whole.join(scratch.save(copies, "copies").hint("merge"), row).select(*columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the text decoded from them."""
    # executors that have run four stages have less memory to spare: smaller caches, the same ids
    return bpe_fst.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"), with_ids=True, most_chunks=80_000, most_states=120_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: SQL can express neither the classifier nor the transducer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for at, (name, stage) in enumerate(STAGES):
        done = scratch.save(stage(spark, docs, sf_dir), name)
        if at:
            scratch.drop(docs)
        docs = done
    return docs
