"""Which version of a key a reader sees.

The snapshot predicate goes below the resolution, the tombstone predicate above it: the other way round old
versions would come back. ``row_number() = 1`` plans as a group limit before and after one exchange on the key, so
each task sends at most one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def newest_first():
    return Window.partitionBy("k").orderBy(F.col("seq").desc(), F.col("kind").desc())


def newest(history: DataFrame, at: int | None = None) -> DataFrame:
    """The newest version of every key up to sequence number ``at``, tombstones included."""
    seen = history if at is None else history.where(F.col("seq") <= at)
    return seen.withColumn("_rank", F.row_number().over(newest_first())).where("_rank = 1").drop("_rank")


def live(history: DataFrame, at: int | None = None) -> DataFrame:
    """What a reader finds: newest versions that aren't tombstones."""
    return newest(history, at).where("kind = 1")


def newest_seq(history: DataFrame) -> DataFrame:
    """(k, seq): without a payload a hash aggregation is enough."""
    return history.groupBy("k").agg(F.max("seq").alias("seq"))


def get(history: DataFrame, key: str, at: int | None = None) -> DataFrame:
    """One key. The predicate reaches the scan where k is a stored column; where it is computed, bound the stored one too."""
    return live(history.where(F.col("k") == key), at)


def multi_get(keys: DataFrame, history: DataFrame, at: int | None = None) -> DataFrame:
    """keys (k) with v and found; keys without a live version stay, with found 0."""
    state = live(history.join(keys.select("k").distinct(), "k", "left_semi"), at).select("k", "v", F.lit(1).alias("_found"))
    return keys.join(state, "k", "left").select("k", "v", F.coalesce("_found", F.lit(0)).alias("found"))


def sweep(history: DataFrame, step: int) -> DataFrame:
    """(snap, k, seq, v): what is live at every multiple of step up to the newest write.

    Each version is visible from its own snapshot to the one before its successor's, so every key's versions expand
    only to the snapshots they serve; no pairing of snapshots with the whole history.
    """
    newer = F.lead("seq").over(Window.partitionBy("k").orderBy("seq"))
    top = history.agg(F.max("seq").alias("top"))
    ranged = history.withColumn("_next", newer).where("kind = 1").join(F.broadcast(top))
    first = F.ceil(F.col("seq") / step)
    last = F.coalesce(F.ceil(F.col("_next") / step) - 1, F.ceil(F.col("top") / step))
    return ranged.where(first <= last).select(F.explode(F.sequence(first, last)).alias("snap"), "k", "seq", "v").withColumn("snap", F.col("snap") * step)


def as_of(asked: DataFrame, history: DataFrame, width: int = 100_000) -> DataFrame:
    """asked (k, at) with seq, v and found: for each row the newest version of its key up to at; found is 0 for none and
    for tombstones. A key with many versions is dealt out by steps of width sequence numbers.

    Versions and questions are sorted together inside (key, step) and the last version before each question is taken; what
    comes from earlier steps is the newest version of each step, carried forward over rows of one a step.
    """
    step = F.floor(F.col("seq") / width)
    version = F.struct("seq", "kind", "v")
    newest_of_step = history.groupBy("k", step.alias("step")).agg(F.max(version).alias("last"))
    steps = newest_of_step.unionByName(asked.select("k", F.floor(F.col("at") / width).alias("step")).distinct().withColumn("last", F.lit(None).cast(newest_of_step.schema["last"].dataType)))
    by_step = steps.groupBy("k", "step").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("k").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_step.select("k", "step", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    asked = asked.select("k", F.col("at").cast("long").alias("at"))
    events = history.select("k", "seq", F.lit(0).alias("_asks"), version.alias("_version")).unionByName(
        asked.select("k", F.col("at").alias("seq"), F.lit(1).alias("_asks"), F.lit(None).cast(newest_of_step.schema["last"].dataType).alias("_version"))
    )
    own = Window.partitionBy("k", "step").orderBy("seq", "_asks", "_version").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("step", step).withColumn("_seen", F.last("_version", ignorenulls=True).over(own)).where("_asks = 1")
    found = seen.join(carried, ["k", "step"], "left").withColumn("s", F.coalesce("_seen", "carried"))
    there = F.coalesce(F.col("s.kind") == 1, F.lit(False))
    return found.select("k", F.col("seq").alias("at"), F.when(there, F.col("s.seq")).alias("seq"), F.when(there, F.col("s.v")).alias("v"), there.cast("long").alias("found"))
