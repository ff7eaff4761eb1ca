"""Versioned histories: (k, seq, kind, v, f), one row for each write; kind 1 sets, kind 0 deletes, f is the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.ranges import placed

SET, DELETE = 1, 0
#: Keys of a shard: a shard of the store has a write buffer of its own, and shards grow in number with the keys.
SHARD_KEYS = 50
#: Entries of a commit that one task numbers.
FEW = 10_000
MAX_SEQ = (1 << 56) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Digits of a key made of a number: all that a long can have, so that keys order as the numbers do and none is cut.
KEY_DIGITS = 19


def number_key(number: Column) -> Column:
    return F.lpad(number.cast("string"), KEY_DIGITS, "0")


def key_of(number: int) -> str:
    return f"{number:0{KEY_DIGITS}d}"


def bounded(df: DataFrame, number: str, low: str | None, high: str | None) -> DataFrame:
    """Rows whose key lies in [low, high), said of the stored number where a bound is a whole key, so that it reaches the scan."""
    def stored(bound: str | None) -> bool:
        return bound is not None and len(bound) == KEY_DIGITS and bound.isascii() and bound.isdigit()

    if stored(low):
        df = df.where(F.col(number) >= int(low))
    if stored(high):
        df = df.where(F.col(number) < int(high))
    return df


def events(spark: SparkSession, sf_dir: str, low: str | None = None, high: str | None = None, at: int | None = None) -> DataFrame:
    """Writes by user; errors delete; runs of 1000 writes, batches of 10 with place i. Of keys in [low, high) and up to
    sequence number at; these bounds are pushed into the scan as bounds of the stored columns."""
    kind = F.when(F.col("event_type") == "error", DELETE).otherwise(SET)
    stored = bounded(read(spark, sf_dir, "events"), "user_id", low, high)
    if at is not None:
        stored = stored.where(F.col("event_id") <= at - 1)
    return stored.select(
        number_key(F.col("user_id")).alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        kind.alias("kind"),
        F.when(kind == SET, F.concat("event_type", F.lit(":"), "props")).alias("v"),
        (F.floor(F.col("event_id") / 1000) + 1).alias("f"),
        F.floor(F.col("event_id") / 10).alias("batch"),
        (F.col("event_id") % 10).alias("i"),
        F.col("props"),
        F.floor(F.col("user_id") / SHARD_KEYS).alias("shard"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes by customer; finished orders delete."""
    kind = F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(SET)
    return read(spark, sf_dir, "orders").select(
        number_key(F.col("o_custkey")).alias("k"), (F.col("o_orderkey") + 1).alias("seq"), kind.alias("kind"),
        F.when(kind == SET, F.col("o_orderpriority")).alias("v"), (F.floor(F.col("o_orderkey") / 1500) + 1).alias("f"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys clustered by run: a key for each turn of a conversation, 16 conversations a run. (k, kind, v, f)"""
    return read(spark, sf_dir, "conversations").select(
        F.concat(number_key(F.col("conv_id")), F.lit(":"), number_key(F.col("turn"))).alias("k"),
        F.lit(SET).alias("kind"), F.col("role").alias("v"), (F.floor(F.col("conv_id") / 16) + 1).alias("f"),
    )


def last_seq(history: DataFrame) -> int:
    """The newest sequence number; one row comes to the driver."""
    return history.agg(F.max("seq")).first()[0] or 0


def numbered(batch: DataFrame, base: int, order: str = "i") -> DataFrame:
    """Entries of one commit with seq = base + place. The entries of a large commit are numbered by ranges of the order, side by
    side; batch must give the same rows each time it is read."""
    if batch.limit(FEW + 1).count() <= FEW:
        place = F.row_number().over(Window.orderBy(order))
        return batch.withColumn("seq", F.lit(base - 1).cast("long") + place)
    return placed(batch, order, [F.col(order)], "_place").withColumn("seq", F.lit(base - 1).cast("long") + F.col("_place")).drop("_place")
