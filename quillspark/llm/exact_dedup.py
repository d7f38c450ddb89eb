"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

A text's digest is the SHA-256 of its UTF-8 bytes after deleting the six space
characters of ``[\\x20\\x09-\\x0D]``. The index is a bucketed Parquet table with a partition a
batch; a batch is grouped by digest (with map-side partial aggregation, so a digest that
a third of the rows share reaches the shuffle as one row a task), anti-joined
to the index by sort-merge without shuffling the index, and the batch's counts are
appended: a row for each of its digests, new or known, which readers add up.

A batch has a name. Running it again under that name, say after its caller died before the result was
written, leaves its own rows of the index aside and then replaces them, so nothing is lost and nothing counted
twice. ``compact`` merges all batches into one sorted file a bucket, with as many buckets as the index needs by
then; batches merged so can no longer be run again.

Defined results: null text counts as empty; empty texts equal one another; of
equal texts the row with most code points stays, then the smallest doc_id
(nulls last), then the first row read, so exactly one row of a group stays
even among repeated rows. A null doc_id is kept as it is. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import SPACES, Scratch, drop_path, free_name, no_text, row_id, scratch_path

COLUMNS = ["digest", "keep_id", "keep_chars", "keep_row", "group_size"]
#: Buckets of a new index, and digests a bucket after compaction.
BUCKETS, PER_BUCKET = 32, 2_000_000


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(text, SPACES, ""), 256))


def place(chars: str, doc_id: str, row: str) -> Column:
    """What the row that stays has most of: code points, then a small doc_id (null last), then a small row."""
    return F.struct(F.col(chars).alias("n"), (-F.coalesce(F.col(doc_id), F.lit(2**63 - 1))).alias("a"), (-F.coalesce(F.col(row), F.lit(0))).alias("b"))


class DigestIndex:
    """Digests seen so far, at ``path``; reopened by any later session with the same path.

    The folder holds generations ``gen-N`` of the bucketed table; the highest one that is complete counts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._generations()
        self.generation, self.buckets = max(found.items()) if found else (0, buckets)
        self._reopen()

    def _folder(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _generations(self) -> dict[int, int]:
        """Complete generations and their bucket counts, both written in the name of the folder that marks them."""
        where, files = self._folder()
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return {int(n.split("-")[1]): int(n.split("-")[2]) for n in names if n.startswith("complete-")}

    def _open(self) -> None:
        self.name = "quill_digests_" + hashlib.sha256(f"{self.path}/{self.generation}".encode()).hexdigest()[:16]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_chars BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/gen-{self.generation}'"
        )

    def _reopen(self) -> None:
        self._open()
        if self.generation in self._generations():
            self.spark.catalog.recoverPartitions(self.name)
        else:
            self._complete()

    def _complete(self) -> None:
        where, files = self._folder()
        files.mkdirs(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete-{self.generation}-{self.buckets}"))

    def rows(self, without: str | None = None) -> DataFrame:
        """A row for each digest and batch, but for those of the batch ``without``."""
        rows = self.spark.table(self.name)
        return (rows if without is None else rows.where(F.col("batch") != without)).select(*COLUMNS)

    def table(self, without: str | None = None) -> DataFrame:
        """A row a digest: the best row of all batches (keep_id, keep_chars, keep_row), and group_size, which counts the rows of all."""
        best = F.max_by(F.struct("keep_id", "keep_chars", "keep_row"), place("keep_chars", "keep_id", "keep_row"))
        return self.rows(without).groupBy("digest").agg(best.alias("k"), F.sum("group_size").alias("group_size")).select("digest", "k.*", "group_size")

    def unseen(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """Groups whose digest no other batch has: a sort-merge anti-join; only the batch moves."""
        return groups.join(self.rows(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """The rows (COLUMNS) of a batch, in place of those it may have there already. The write is one job, whose files appear when all tasks are done."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch has a name of letters, digits, dots and dashes, not {batch!r}")
        rows = groups.select(*COLUMNS).repartition(self.buckets, "digest")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT * FROM {{rows}}", rows=rows)
        self.spark.catalog.refreshTable(self.name)

    def compact(self, per_bucket: int = PER_BUCKET) -> None:
        """Merges all batches into a new generation, then drops the old one; a reader of either sees every digest."""
        merged = self.table()
        old, n = self.name, merged.count()
        older = f"{self.path}/gen-{self.generation}"
        self.generation, self.buckets = self.generation + 1, max(self.buckets, -(-n // per_bucket))
        where, files = self._folder()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files.delete(path(f"{self.path}/gen-{self.generation}"), True)  # what a compaction that died has left
        self._open()
        self.append(merged, "compacted")
        self._complete()
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        for status in files.listStatus(where):
            if status.getPath().getName().startswith(f"complete-{self.generation - 1}-"):
                files.delete(status.getPath(), True)
        files.delete(path(older), True)

    def drop(self) -> None:
        """Forgets the table in the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    text = no_text(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_digest(text).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"),
        (F.col(row_col) if row_col else row_id()).alias("row_id"),
    )


def survivors(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; their digests are in the index afterwards."""
    row = free_name(docs, "__row")
    whole = Scratch(docs.sparkSession).save(docs.withColumn(row, row_id()), "documents")
    kept = dedup(whole, index, id_col, text_col, row, batch).where("kept").select(F.col("row_id").alias(row))
    return whole.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def enter(rows: DataFrame, index: DigestIndex, batch: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Puts a batch of digest rows into the index; its groups (digest, keep_id, keep_chars, keep_row, group_size), and those of them that are new."""
    best = F.max_by(F.struct(F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.col("row_id").alias("keep_row")), place("n_chars", "doc_id", "row_id"))
    groups = scratch.save(rows.groupBy("digest").agg(best.alias("k"), F.count("*").alias("group_size")).select("digest", "k.*", "group_size"), "groups")
    fresh = scratch.save(index.unseen(groups, batch), "fresh")
    index.append(groups, batch)
    return groups, fresh


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, known, text_sha256, row_id.

    A digest that another batch knows already keeps the best row named there (``known``, none of this batch
    stays); group_size then counts the rows of all batches so far. Give the batch a name to be able to run it again.
    """
    batch = batch or uuid.uuid4().hex
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(digest_rows(docs, id_col, text_col, row_col), "digests")
    groups, fresh = enter(rows, index, batch, scratch)
    mine = groups.join(fresh.select("digest"), "digest", "left_anti").select("digest", F.col("group_size").alias("more"))
    old = mine.join(index.table(batch), "digest").select("digest", "keep_id", F.lit(None).cast("long").alias("keep_row"), (F.col("group_size") + F.col("more")).alias("group_size"))
    known = scratch.save(old.unionByName(fresh.select("digest", "keep_id", "keep_row", "group_size")), "known")
    scratch.drop(groups, fresh)
    return rows.join(known, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("keep_row").isNull().alias("known"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_id",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, entered into a new index as two batches (even doc_ids, then odd ones); of both the best row stays.

    ``known`` says that the index had the text before the document's batch came.
    """
    from quillspark.sources.tables import table

    scratch, path = Scratch(spark), scratch_path(spark, "index")
    index = DigestIndex(spark, path)
    part = F.pmod(F.coalesce("doc_id", "row_id"), F.lit(2))
    rows = scratch.save(digest_rows(table(spark, sf_dir, "documents")), "digests")
    enter(rows.where(part == 0), index, "even", scratch)
    _, fresh = enter(rows.where(part == 1), index, "odd", scratch)
    # a text is new to the second batch, or the first one had it
    best = index.table().join(fresh.select("digest", F.lit(True).alias("late")), "digest", "left")
    best = scratch.save(best.select("digest", "keep_id", "keep_row", "group_size", F.coalesce("late", F.lit(False)).alias("late")), "best")
    index.drop()
    drop_path(spark, path)
    return rows.join(best, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), ((part == 1) & ~F.col("late")).alias("known"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size, min(doc_id % 2) OVER (PARTITION BY text_sha256) = 0 AS has_even,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, doc_id % 2 = 1 AND has_even AS known, text_sha256 FROM r
"""
