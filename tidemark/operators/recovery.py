"""What survives a crash: prefixes before damage, the last sequence number, and the logs to replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.shipping import ship

REPLAYED = "log long, k string, seq long, kind int, v string"


def before_damage(records: DataFrame, bad: str, log: str | None = None) -> DataFrame:
    """Rows before the first bad record by seq: the first bad place is one aggregate, compared by a broadcast of one
    row (a row for each log if log names a column), so nothing is sorted."""
    at = records.where(bad)
    if log:
        first = at.groupBy(log).agg(F.min("seq").alias("_bad"))
        return records.join(first, log, "left").where("_bad is null or seq < _bad").drop("_bad")
    return records.join(F.broadcast(at.agg(F.min("seq").alias("_bad")))).where("_bad is null or seq < _bad").drop("_bad")


def last_sequence(batches: DataFrame) -> DataFrame:
    """batches: (base, n); empty batches use no number."""
    return batches.where("n > 0").agg(F.max(F.col("base") + F.col("n") - 1).alias("last_seq"))


def replay_order(logs: DataFrame, first: int) -> DataFrame:
    """(name, number, pos) of logs to replay, oldest first. logs: (number); a log is a file, so one sort is enough."""
    kept = logs.where(F.col("number") >= first)
    return kept.select(F.format_string("%06d.log", "number").alias("name"), "number", F.row_number().over(Window.orderBy("number")).cast("long").alias("pos"))


def logs(spark: SparkSession, folder: str, first: int = 0) -> DataFrame:
    """(number, content) of the logs in a folder from number first on, a row for each file; other files are left out."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)).where(F.col("number") >= first)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(number, content) of closed logs as they come, a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _named(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.log").load(folder))


def _named(files: DataFrame) -> DataFrame:
    number: Column = F.regexp_extract("path", r"([0-9]+)\.log$", 1)
    return files.where(number != "").select(number.cast("long").alias("number"), "content")


def replay(found: DataFrame) -> DataFrame:
    """REPLAYED of logs (number, content): every entry of every batch up to a log's first damage, which is where its writer
    died; what lies behind was never acknowledged. A whole record that holds no batch is an error. Keys and values are UTF-8.
    A log is a task's work, as a buffer's worth of writes is all that it holds; logs are dealt out and their order doesn't matter,
    since sequence numbers decide."""
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for record in codec.readable(content.as_py() or b"")[0]:
                    seq, entries = codec.decode_batch(record)
                    rows += [(number.as_py(), key.decode(), seq + i, kind, None if value is None else value.decode()) for i, (kind, key, value) in enumerate(entries)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["log", "k", "seq", "kind", "v"])

    return found.select("number", "content").mapInArrow(run, REPLAYED)


def write_logs(history: DataFrame) -> DataFrame:
    """(number, content) of a framed log for each run f of history (f, batch, i, k, seq, kind, v), a record for each batch."""
    ship(history.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["batch", "i", "seq", "kind", "k", "v"]).to_pylist(), key=lambda r: (r["batch"], r["i"]))
        batches: dict[int, list[dict]] = {}
        for r in rows:
            batches.setdefault(r["batch"], []).append(r)
        records = [codec.encode_batch(own[0]["seq"], [(r["kind"], r["k"].encode(), None if r["v"] is None else r["v"].encode()) for r in own]) for own in batches.values()]
        return pa.table({"number": group.column("f").slice(0, 1), "content": pa.array([codec.frame(records)], pa.binary())})

    return history.select("f", "batch", "i", "k", "seq", "kind", "v").groupBy("f").applyInArrow(run, "number long, content binary")
