"""Computations along an order: smoothing, deltas, numbering, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped_average(value: Column, keys: list[str], order: list[str], radius: int = 2) -> Column:
    """Centred moving average whose window repeats the edge values, so the divisor is always 2 * radius + 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = value
    for k in range(1, radius + 1):
        total = total + F.coalesce(F.lag(value, k).over(w), F.first(value).over(full)) + F.coalesce(F.lead(value, k).over(w), F.last(value).over(full))
    return total / (2 * radius + 1)


def usage(idle: Column, total: Column, keys: list[str], order: list[str]) -> Column:
    """1 - idle's share of the growth since the sample before; 0 if nothing grew, null on the first sample."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d_idle, d_total = idle - F.lag(idle).over(w), total - F.lag(total).over(w)
    return F.when(d_total.isNull(), F.lit(None)).when(d_total > 0, 1 - d_idle / d_total).otherwise(0.0)


def delta(value: Column, keys: list[str], order: list[str]) -> Column:
    """Growth since the row before; the first row's own value."""
    return value - F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "index") -> DataFrame:
    """Rows with their number from 0, before any filter."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def changed(value: Column, keys: list[str], order: list[str]) -> Column:
    """Whether the value differs from the row before; true on the first."""
    return ~F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)).eqNullSafe(value)


def next_marked(position: Column, mark: Column, keys: list[str], order: list[str]) -> Column:
    """The next position behind this row that is marked."""
    # a frame that ends with the key is folded anew for each row; in the other direction it begins with the key
    w = Window.partitionBy(*keys).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(mark, position), ignorenulls=True).over(w)


def last_heading(heading: Column, keys: list[str], order: list[str]) -> Column:
    """The nearest heading at or before this row."""
    return F.last(heading, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def progress(keys: list[str], order: list[str]) -> Column:
    """Percent of the rows of the key done with this one."""
    return 100 * F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) / F.count("*").over(Window.partitionBy(*keys))


def bucket(n: Column, size: int) -> tuple[Column, Column]:
    """Bucket and place in it of numbers from 1 in buckets of `size`."""
    return F.floor((n - 1) / size).cast("long"), F.pmod(n - 1, F.lit(size))


def same_bucket(n: Column, target: int, size: int = 10) -> Column:
    """The number that has place `target` (from 1) in the bucket of n."""
    return F.floor((n - 1) / size).cast("long") * size + target


def occupancy(used: DataFrame, key: str, number: str, first: int, last: int) -> DataFrame:
    """key, number, occupied for every number of a range."""
    keys = used.select(key).distinct()
    grid = keys.select(key, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(number))
    return grid.join(used.select(key, F.col(number).cast("int").alias(number)).distinct().withColumn("_u", F.lit(True)), [key, number], "left").select(key, number, F.coalesce("_u", F.lit(False)).alias("occupied"))


def rising_edges(df: DataFrame, condition: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows where a condition turns true after being false; the first row does not count."""
    now = F.coalesce(condition, F.lit(False))
    before = F.lag(now).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_e", now & ~before).where("_e").drop("_e")
