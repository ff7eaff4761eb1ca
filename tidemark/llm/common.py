"""Shared pieces: reading tables, cutting lineage into the cluster's shared folder, splitting texts into words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Small sides are broadcast up to so many counted rows; beyond, joins shuffle both sides.
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset (tests in local mode), one of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: later plans start there, and a lost
    executor costs no recomputation. Files go with free, or when the driver's Python ends."""
    spark = df.sparkSession
    path, seen = f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path, out._cut_rows = path, int(seen.get["rows"])
    return out


def is_empty(df: DataFrame) -> bool:
    """Whether a cut table has no rows."""
    return df._cut_rows == 0


def free(*tables: DataFrame) -> None:
    """Remove the files of cut tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path and (df.sparkSession, path) in _written:
            _written.remove((df.sparkSession, path))
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - a session that has ended can't delete; the others still can
            continue


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has at most so many rows (BROADCAST_ROWS). A cut table was counted as it was written; others are counted."""
    rows = BROADCAST_ROWS if rows is None else rows
    if hasattr(df, "_cut_rows"):
        return df._cut_rows <= rows
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is small, else df as it is, for Spark to shuffle."""
    return F.broadcast(df) if is_small(df, rows) else df


def quoted(column: str) -> Column:
    """The column of exactly that name."""
    return F.col("`" + column.replace("`", "``") + "`")


def attach(rows: DataFrame, side: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined with side (a cut table, a row for each key), whose columns must be new but for key.

    A small side is broadcast. Of a larger one the keys of most weight (rows that they meet) are, a tenth of BROADCAST_ROWS
    of them; what they leave is joined by a shuffle, in which rows that are done or have no key are dealt at random. So
    no task gets all rows of a heavy key.
    """
    if is_small(side):
        return rows.join(F.broadcast(side), key, "left")
    heavy = cut(side.orderBy(F.col(weight).desc(), key).limit(max(1, BROADCAST_ROWS // 10)), "heavy")
    columns = [c for c in side.columns if c != key]
    first = rows.join(F.broadcast(heavy.select(key, F.struct(*columns).alias("_at_heavy"))), key, "left")
    done = F.col("_at_heavy").isNotNull() | F.col(key).isNull()
    random = F.xxhash64(*[quoted(c) for c in rows.columns if _hashable(rows, c)])
    first = first.withColumns({"_at_deal": F.when(done, random), "_at_open": F.when(~done, F.col(key))})
    light = side.join(F.broadcast(heavy.select(key)), key, "left_anti").select(F.lit(None).cast("long").alias("_at_no"), F.col(key).alias("_at_key"), F.struct(*columns).alias("_at_light"))
    joined = first.join(light, F.col("_at_deal").eqNullSafe(F.col("_at_no")) & F.col("_at_open").eqNullSafe(F.col("_at_key")), "left")
    found = F.coalesce("_at_heavy", "_at_light")
    return joined.select(*[quoted(c) for c in rows.columns], *[found[c].alias(c) for c in columns])


def _hashable(rows: DataFrame, column: str) -> bool:
    return "map<" not in rows.schema[column].dataType.simpleString() and "variant" not in rows.schema[column].dataType.simpleString()


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that an operator doesn't use renamed, so that none clashes with its own."""
    return docs.toDF(*[c if c in used else f"_aside_{i}" for i, c in enumerate(docs.columns)])


def back(found: DataFrame, docs: DataFrame, used: tuple[str, ...], added: Iterable[str] = ()) -> DataFrame:
    """What an operator made of aside(docs, *used): columns of docs under their own names, then the added ones. A column
    of docs that is named as an added one gives way to it."""
    added = list(added)
    own = [quoted(c if c in used else f"_aside_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added]
    return found.select(*own, *added)


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of text, a row at least: Python holds one piece at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; none for an empty one."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, y) of at most max_rows labelled ids outside the held-out fifth, in the order of a hash of the id.

    An id with several labels counts as 1 if any is 1. Null ids and labels are left out.
    """
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
