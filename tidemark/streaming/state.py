"""Keeping the newest version of every key from a stream of writes.

The stream is aggregated by key inside Spark (state store, map-side combine); order of arrival doesn't matter, as only
a higher sequence number replaces a version. Each micro-batch's changed keys go to a folder named by the batch id,
overwritten if the batch is run again, so a restart repeats nothing and loses nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.resolve import newest

STATE = "k string, seq long, kind int, v string"


def maintain(changes: DataFrame, folder: str, available_now: bool = True):
    """Start a query on changes (k, seq, kind, v) that keeps its state under folder."""
    by_key = changes.groupBy("k").agg(F.max(F.struct("seq", "kind", "v")).alias("s")).select("k", "s.seq", "s.kind", "s.v")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    writer = by_key.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _folders(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in files.listStatus(path)] if files.exists(path) else []


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(k, seq, kind, v) of every key that the stream has seen, tombstones included."""
    found = _folders(spark, folder)
    if not found:  # no batch has run yet
        return spark.createDataFrame([], STATE)
    return newest(spark.read.schema(STATE).parquet(*found)).select("k", "seq", "kind", "v")


def compact(spark: SparkSession, folder: str) -> None:
    """All folders of batches into one with the newest version of every key, so that what latest reads grows with the keys and
    not with the batches. The new folder is whole before the old ones go; a crash between leaves rows twice, which changes
    nothing. Not beside a reader."""
    found = _folders(spark, folder)
    if len(found) > 1:
        latest(spark, folder).write.parquet(f"{folder}/state/all-{uuid.uuid4().hex}")
        for old in found:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
