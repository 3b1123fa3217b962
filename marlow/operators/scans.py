"""Computations along an order in which one key, or the whole table, may be larger than a task.

Rows are range-partitioned by key and order, ties by a hash of the row, and written once: each partition is a shard, and
a row's place in the table is its number. Within a shard the rows of a key are a window. Each shard and key is folded to
a summary (rows, sum, first and last values); summaries of a key, a few for each shard, are scanned in order, and what
comes in from the shards before or behind is joined to the rows. Null keys are a key; nulls in the order come first.

Order columns are names or sort expressions; rows that tie in all of them stand in an order of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlow.sources.shared import written

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing
# A shard's rows, about: tables that grow get more shards, so that none is more for a task.
SHARD_ROWS = 500_000


def _local() -> WindowSpec:
    """The rows of a key in a shard."""
    return Window.partitionBy("_shard", "_key").orderBy("_at")


def _shards(lo: int, hi: int) -> WindowSpec:
    """Summaries of a key, relative to a shard's own."""
    return Window.partitionBy("_key").orderBy("_shard").rowsBetween(lo, hi)


def shards_of(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SHARD_ROWS))


def sharded(df: DataFrame, keys: list[str], order: list[str | Column], **values: Column) -> DataFrame:
    """df with values as columns, _key, _at (its place in key and order) and _shard, as a table in the shared folder, read back with whole shards of a key in a task."""
    rows = df.withColumns(values | {"_key": F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))})
    by = ["_key", *order, F.xxhash64(*df.columns)]
    n = shards_of(df)
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    # as many partitions as shards
    return written(placed, "shards").withColumn("_shard", F.shiftright("_at", 33)).repartition(n, "_shard", "_key")


def _carried(rows: DataFrame, summary: list[Column], carry: dict[str, Column]) -> DataFrame:
    """rows with what each shard and key learns from the summaries of the others."""
    told = rows.groupBy("_shard", "_key").agg(*summary).select("_shard", "_key", *[c.alias(n) for n, c in carry.items()])
    return rows.join(told.hint("merge"), ["_shard", "_key"])


def _plain(df: DataFrame, out: DataFrame, **results: Column) -> DataFrame:
    return out.select(*df.columns, *[c.alias(n) for n, c in results.items()])


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "number", percent: str | None = None, **sums: Column) -> DataFrame:
    """df with each row's number from 1 in its key and, if asked for, the percent of the key's rows done with it and running sums by name, nulls adding nothing."""
    every = Window.partitionBy("_key")
    rows = sharded(df, keys, order, **{f"_v{k}": F.coalesce(v, F.lit(0)) for k, v in enumerate(sums.values())})
    ahead = lambda c: F.coalesce(F.sum(c).over(_shards(FIRST, -1)), F.lit(0))
    summary = [F.count("*").alias("_n"), *[F.sum(f"_v{k}").alias(f"_s{k}") for k in range(len(sums))]]
    out = _carried(rows, summary, {"_before": ahead("_n"), "_total": F.sum("_n").over(every)} | {f"_b{k}": ahead(f"_s{k}") for k in range(len(sums))})
    n = F.row_number().over(_local()) + F.col("_before")
    totals = {s: F.sum(f"_v{k}").over(_local().rowsBetween(FIRST, 0)) + F.col(f"_b{k}") for k, s in enumerate(sums)}
    return _plain(df, out, **{name: n} | ({percent: 100 * n / F.col("_total")} if percent else {}) | totals)


def running_sum(df: DataFrame, value: Column, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with the sum of a value up to and with this row; nulls add nothing."""
    rows = sharded(df, keys, order, _v=F.coalesce(value, F.lit(0)))
    out = _carried(rows, [F.sum("_v").alias("_s")], {"_before": F.coalesce(F.sum("_s").over(_shards(FIRST, -1)), F.lit(0))})
    return _plain(df, out, **{name: F.sum("_v").over(_local().rowsBetween(FIRST, 0)) + F.col("_before")})


def around(df: DataFrame, value: Column, keys: list[str], order: list[str | Column], last: str | None = None, following: str | None = None) -> DataFrame:
    """df with the nearest value that is not null at or before this row, the nearest one behind it, or both."""
    rows = sharded(df, keys, order, _v=value)
    known = F.when(F.col("_v").isNotNull(), F.col("_at"))
    summary = [F.max_by("_v", known).alias("_l"), F.min_by("_v", known).alias("_f")]
    out = _carried(rows, summary, {"_before": F.last("_l", ignorenulls=True).over(_shards(FIRST, -1)), "_behind": F.last("_f", ignorenulls=True).over(Window.partitionBy("_key").orderBy(F.desc("_shard")).rowsBetween(FIRST, -1))})
    # a frame that ends with the key is folded anew for each row, so the rows behind are read as those before in the other direction
    back = Window.partitionBy("_shard", "_key").orderBy(F.desc("_at")).rowsBetween(FIRST, -1)
    told = {last: F.coalesce(F.last("_v", ignorenulls=True).over(_local().rowsBetween(FIRST, 0)), F.col("_before"))} if last else {}
    return _plain(df, out, **told | ({following: F.coalesce(F.last("_v", ignorenulls=True).over(back), F.col("_behind"))} if following else {}))


def last_known(df: DataFrame, value: Column, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with the nearest value that is not null at or before this row."""
    return around(df, value, keys, order, last=name)


def next_known(df: DataFrame, value: Column, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with the nearest value that is not null behind this row."""
    return around(df, value, keys, order, following=name)


def clamped_average(df: DataFrame, value: Column, keys: list[str], order: list[str | Column], name: str, radius: int = 2) -> DataFrame:
    """df with the centred moving average whose window repeats the key's first and last values; a null in it makes it null.

    A summary holds the first and last `radius` values of a shard. As each shard of a key has a row of it, as many shards on
    either side hold all that a window can reach.
    """
    rows = sharded(df, keys, order, _v=value)
    edge = F.struct("_at", "_v")
    rows = rows.withColumns({"_head": F.when(F.lag(F.lit(1), radius).over(_local()).isNull(), edge), "_tail": F.when(F.lead(F.lit(1), radius).over(_local()).isNull(), edge)})
    near = lambda c, lo, hi: F.transform(F.flatten(F.collect_list(c).over(_shards(lo, hi))), lambda x: x["_v"])
    every = _shards(FIRST, LAST)
    summary = [F.count("*").alias("_n"), F.array_sort(F.collect_list("_head")).alias("_h"), F.array_sort(F.collect_list("_tail")).alias("_t")]
    carry = {"_n": F.col("_n"), "_prev": near("_t", -radius, -1), "_next": near("_h", 1, radius), "_first": F.first(F.element_at("_h", 1)).over(every), "_last": F.last(F.element_at("_t", -1)).over(every)}
    out = _carried(rows, summary, carry)
    here, place = F.struct("_v"), F.row_number().over(_local())
    total = F.col("_v")
    for k in range(1, radius + 1):
        # how far the row k before is behind the shard's beginning, and the row k behind beyond its end
        back, on = k - place, k - (F.col("_n") - place)
        before = F.when(back < 0, F.lag(here, k).over(_local())["_v"]).otherwise(F.when(F.size("_prev") > back, F.get("_prev", F.size("_prev") - 1 - back)).otherwise(F.col("_first._v")))
        behind = F.when(on <= 0, F.lead(here, k).over(_local())["_v"]).otherwise(F.when(F.size("_next") >= on, F.get("_next", (on - 1).cast("int"))).otherwise(F.col("_last._v")))
        total = total + before + behind
    return _plain(df, out, **{name: total / (2 * radius + 1)})
