"""Dealing rows out by ranges of their order, places in it, and sides whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values that ranges are cut from, and ranges, at most.
SAMPLE, PARTS = 10_000, 256
#: Small sides are broadcast up to so many counted rows.
BROADCAST_ROWS = 500_000
_STEP = 16


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (they are counted), else as it is, for Spark to shuffle."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounds(df: DataFrame, column: str, parts: int = PARTS) -> list:
    """Fewer than parts values, ascending, that cut the column into about equal ranges: quantiles of the SAMPLE distinct
    values of least hash. The same rows give the same bounds."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    found = sorted(r[0] for r in values.orderBy(F.xxhash64(column), column).limit(SAMPLE).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def range_of(value: Column, cuts: list) -> Column:
    """How many of the bounds are at or below value: a coarse search over every 16th, then one among 16."""
    if not cuts:
        return F.lit(0)
    coarse = F.size(F.filter(F.lit(cuts[::_STEP]), lambda b: b <= value))
    fine = F.size(F.filter(F.slice(F.lit(cuts), (coarse - 1) * _STEP + 1, _STEP), lambda b: b <= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * _STEP + fine)


def placed(df: DataFrame, column: str, order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) in the order, which begins with the column: places inside ranges of the column, and
    the ranges' own offsets, a sum over at most PARTS rows. One exchange of the rows; a range holds all rows of a value."""
    cuts = bounds(df, column)
    ranged = df.withColumn("_range", range_of(F.col(column), cuts))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_before")
