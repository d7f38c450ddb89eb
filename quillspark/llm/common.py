"""What the corpus operators share: word pattern, scratch tables, checked broadcasts.

Scratch tables are Parquet under ``spark.checkpoint.dir``, which every executor
and the driver share. A lost executor costs a re-run of its tasks from the last
written table, never of the whole lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a string and as regex classes.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Rows up to which a table may be broadcast by hint; above it the join shuffles.
BROADCAST_ROWS = 50_000

_made: dict[str, SparkSession] = {}
_own_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session, or an own temp folder where none is set (local tests)."""
    global _own_root
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    return _own_root


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/quill-{uuid.uuid4().hex}/{name}"
    _made[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)
    _made.pop(path, None)


class Scratch:
    """Tables written for one run of an operator; drop() frees those no result reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self._keep: list[DataFrame] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep.append(out)
        return out

    def drop_all(self) -> None:
        """Frees every table of this scratch; only for one whose tables no result reads."""
        self.drop(*self._keep)
        self._keep = []

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            if path := self.paths.pop(id(df), None):
                drop_path(self.spark, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is temporary anyway
            return


_claims: dict[str, Callable[[], object]] = {}


def claim(owner: str, release: Callable[[], object]) -> None:
    """In a Python worker: frees the caches of the operators that ran in it before, and names this one's way to free its own.

    Spark reuses workers from stage to stage; only the caches of the running operator should stay.
    """
    for name in [n for n in _claims if n != owner]:
        _claims.pop(name)()
    _claims[owner] = release


def no_text(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters (``[^\\x20\\x09-\\x0D]+``)."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of df has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_id() -> Column:
    """Number of a row in one scan; write it before it is used twice."""
    return F.monotonically_increasing_id()


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a table that is usually small: broadcast once its row count is checked, else shuffle.

    ``rows`` is the count where the caller knows it. Beyond BROADCAST_ROWS the plan is an
    ordinary shuffle join whose skewed partitions adaptive execution splits.
    """
    rows = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, keys, how)
