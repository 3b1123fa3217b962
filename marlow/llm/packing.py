"""Packing texts into padded batches with optimal length buckets.

Texts are cut into pieces of at most `longest` tokens. The global histogram of piece lengths has at
most `longest` rows whatever the corpus; dynamic programming over it places the bucket bounds so
that the padding summed over all pieces is least. In a bucket of bound b every batch holds
budget // b pieces. Numbering inside a bucket is spread over shards: rows are numbered in their
shard, and shards begin where the ones before end, so a bucket with a third of all rows is no
single task's work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm._io import broadcast_if, written

LONGEST, BUCKETS, BUDGET = 2048, 16, 65_536
SHARD_ROWS = 50_000
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Tokens of a text: its words, runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0))


def bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding; ascending lengths in."""
    size, n = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    m = len(size)
    if not m:
        return []
    rows, tokens = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * size))
    # cost[i, j]: padding of lengths i..j-1 in one bucket whose bound is the last of them
    cost = np.full((m + 1, m + 1), np.inf)
    for i in range(m):
        cost[i, i + 1 :] = size[i:] * (rows[i + 1 :] - rows[i]) - (tokens[i + 1 :] - tokens[i])
    best = cost[0].copy()
    best[0] = 0
    back: list[np.ndarray] = []
    for _ in range(min(buckets, m) - 1):
        total = best[:, None] + cost
        before = total.argmin(0)
        new = total[before, np.arange(m + 1)]
        before = np.where(new < best, before, -1)
        best = np.minimum(best, new)
        back.append(before)
    out, j = [], m
    for before in reversed(back):
        if before[j] >= 0:
            out.append(int(size[j - 1]))
            j = int(before[j])
    out.append(int(size[j - 1]))
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket, padded, batch, slot: one row per piece of a text.

    piece counts from 0, start and n_tokens are in tokens, padded is the bucket's bound, batch
    counts inside a bucket and slot inside a batch. Texts that are null or have no tokens have no
    pieces. Rows that share a doc_id are packed each; which of them comes first is open only
    where they are equal in id, piece and length.
    """
    length = word_count(F.col("text")) if length is None else length
    rows = docs.select("doc_id", length.cast("long").alias("n")).where("n > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))).alias("piece")
    pieces = rows.select("doc_id", "n", piece).select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("n_tokens"))
    pieces = written(pieces, "pieces")
    histogram = sorted(tuple(r) for r in pieces.groupBy("n_tokens").count().collect())  # at most `longest` rows
    chosen = bounds([x for x, _ in histogram], [c for _, c in histogram], buckets)
    shards = 1 + sum(c for _, c in histogram) // SHARD_ROWS
    limits = F.array(*[F.lit(b) for b in chosen]) if chosen else F.array(F.lit(longest))
    placed = pieces.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    counts = placed.groupBy("bucket", "shard").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("bucket", "shard", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")) - 1
    numbered = placed.withColumn("number", number).join(broadcast_if(offsets, shards * (len(chosen) or 1), BROADCAST_ROWS), ["bucket", "shard"])
    padded = F.get(limits, F.col("bucket"))
    place, size = F.col("before") + F.col("number"), F.greatest(F.lit(1), F.expr(f"{budget} div padded"))
    return (
        numbered.withColumn("padded", padded).withColumn("place", place).withColumn("size", size.cast("long"))
        .select("doc_id", "piece", "start", "n_tokens", "bucket", "padded", F.expr("place div size").alias("batch"), F.expr("cast(place % size as int)").alias("slot"))
    )
