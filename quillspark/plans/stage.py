"""Cutting lineage: a result written under the shared checkpoint folder and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: dict[str, SparkSession] = {}
_path_of: dict[int, tuple[str, DataFrame]] = {}


def staged(df: DataFrame) -> DataFrame:
    """The same rows, read from Parquet in ``spark.checkpoint.dir`` (an own temp folder where unset, in local mode only); deleted at exit."""
    global _own
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own = _own or f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        root = _own
    path = f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[id(out)] = (path, out)
    return out


def release(df: DataFrame) -> None:
    """Deletes what staged() wrote for df; nothing may read it any more."""
    if found := _path_of.pop(id(df), None):
        _delete(found[0])


def _delete(path: str) -> None:
    spark = _made.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is temporary anyway
            return
