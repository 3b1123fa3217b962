"""Connected components as DataFrame joins: nothing is gathered on the driver, and no key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm._io import drop, written

SALTS = 64
BROADCAST_ROWS = 200_000


def spread_join(rows: DataFrame, known: DataFrame, key: str, spread: str | Column, how: str = "inner") -> DataFrame:
    """rows joined with `known`, which has one row a key: the rows of a key, however many, are dealt to SALTS tasks by `spread`.

    The pairs of key and salt that occur, at most SALTS of a key, fetch what is known first.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    needed = rows.select(key, "_salt").where(F.col(key).isNotNull()).distinct().join(known.hint("merge"), key)
    return rows.join(needed.hint("merge"), [key, "_salt"], how).drop("_salt")


def crowded_join(rows: DataFrame, known: DataFrame, key: str, parts: str, spread: Column) -> DataFrame:
    """rows joined with the written table `known`, one row a key; keys whose `parts` are over 1 have many rows, which don't meet in one task.

    Up to BROADCAST_ROWS such keys are broadcast; if more are counted, rows are dealt by key and a salt of `spread`.
    """
    crowded = known.where(F.col(parts) > 1)
    few = crowded.count()
    if not few:
        return rows.join(known.hint("merge"), key)
    if few > BROADCAST_ROWS:
        return spread_join(rows, known, key, spread)
    split = rows.join(F.broadcast(crowded), key, "left")
    plain = split.where(F.col(parts).isNull()).drop(parts).join(known.where(F.col(parts) == 1).hint("merge"), key)
    return split.where(F.col(parts).isNotNull()).unionByName(plain)


def _with_lowest(edges: DataFrame) -> DataFrame:
    """The different edges(u, v) with m, the smallest v of their u; the edges of a hub are folded and dealt by salts.

    Dealt once by u and salt: repeats go, minima are folded and fetched back within that partitioning.
    """
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).repartition("u", "_salt").distinct()
    folded = salted.groupBy("u", "_salt").agg(F.min("v").alias("m"))
    low = folded.select("u", "_salt", F.min("m").over(Window.partitionBy("u")).alias("m"))
    return salted.join(low.hint("merge"), ["u", "_salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges(a, b).

    Alternating large-star and small-star steps (Kiveris and others, 2014). Nulls, loops and repeated
    edges are ignored; no edges give no rows.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).select("col.*")
        large = _with_lowest(both).select("v", F.least("u", "m").alias("m"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_lowest(large)
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        new = written(small.select(ends).select("col.*").where("u <> v").distinct(), "edges")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop(e)
        e = new
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
