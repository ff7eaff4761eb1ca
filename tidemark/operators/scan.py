"""Ordered scans, range scans and seeks over the order (key ascending, sequence number descending)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.resolve import live
from tidemark.plans.ranges import bounds, range_of

def ordered(history: DataFrame) -> DataFrame:
    """The whole history in internal-key order: a range exchange and local sorts."""
    return history.orderBy(F.col("k").asc(), F.col("seq").desc(), F.col("kind").desc())


def positions(history: DataFrame) -> DataFrame:
    """history with ``pos``, each row's place in internal-key order, from 1.

    Places within a key come from a window on the key, places of keys from running sums of counts: first inside key
    ranges, then over the ranges. Ranges are cut at quantiles of the keys, so none is hot because keys begin alike, and the
    last sum is over few rows.
    """
    counts = history.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_range", range_of(F.col("k"), bounds(history, "k")))
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_rn"))
    before = ranges.select("_range", (F.sum("_rn").over(Window.orderBy("_range")) - F.col("_rn")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_range").orderBy("k")) - F.col("_n")
    offsets = counts.withColumn("_inside", inside).join(F.broadcast(before), "_range").select("k", (F.col("_before") + F.col("_inside")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("k").orderBy(F.col("seq").desc(), F.col("kind").desc()))
    return history.withColumn("_own", own).join(offsets, "k").withColumn("pos", (F.col("_offset") + F.col("_own")).cast("long")).drop("_own", "_offset")


def key_range(history: DataFrame, low: str | None = None, high: str | None = None, at: int | None = None) -> DataFrame:
    """Live rows with low <= k < high; a bound that is None is open."""
    if low is not None:
        history = history.where(F.col("k") >= low)
    if high is not None:
        history = history.where(F.col("k") < high)
    return live(history, at)


def seek_ge(keys: DataFrame, targets: list[str]) -> DataFrame:
    """(target, k): the first key at or after each target, null past the end, in one pass for all targets."""
    firsts: list[Column] = [F.min(F.when(F.col("k") >= t, F.col("k"))).alias(f"_{i}") for i, t in enumerate(targets)]
    found = keys.agg(*firsts)
    return found.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_{i}").alias("k")) for i, t in enumerate(targets)])).alias("s")).select("s.*")


def order_violations(run: DataFrame, place: str = "pos") -> DataFrame:
    """Rows of run (f, k, seq, place) that don't come strictly after the row before them in their run."""
    w = Window.partitionBy("f").orderBy(place)
    pk, ps = F.lag("k").over(w), F.lag("seq").over(w)
    return run.withColumns({"_pk": pk, "_ps": ps}).where((F.col("_pk") > F.col("k")) | ((F.col("_pk") == F.col("k")) & (F.col("_ps") <= F.col("seq")))).drop("_pk", "_ps")
