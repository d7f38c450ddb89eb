"""Resumable ingest: what has been done is not done again.

An extension: the reference resumes page by page and has no streams. A file
source with ``availableNow`` gives the same with a checkpoint in place of status
rows, so that a lost executor or a stopped driver resumes after the last finished batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new_files(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 100) -> int:
    """Applies ``work`` to the Parquet files of a folder not yet processed and appends to ``out``; returns the batches run."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    batches = []

    def run(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a crash replaces its own folder: the result is the same as of one run
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    query = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)
