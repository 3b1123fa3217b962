"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verification.

Each table rotates a vector `width` times by sign flips and Hadamard transforms (three rounds) and
takes the nearest vertex of the cross-polytope each time. A vector lies in its own bucket of every
table and also looks into the buckets next to it (`probes` in all); a pair meets if one looks into the
other's own bucket. Codes alone are shuffled first; only vectors in buckets where two can meet follow,
once for each such bucket, in the numbers they came in. Pairs that meet are verified by cosine in
double precision. A vector has its codes of all tables with it, so a pair that meets in several buckets
is counted in the first alone and link counts need no list of pairs. Buckets over BLOCK rows are dealt
out as pairs of blocks.

The width grows with the table, so that vectors that meet by chance are fewer than their buckets; a
longer code meets less often, so the number of tables follows from the width, the dimensions and the
threshold: random pairs just at the threshold are hashed, and as many tables are taken as leave a miss
of MISS (1 of 10,000); nearer pairs are missed less often. tables_for() gives the number.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths never link; equal vectors are one class and count as links of
each other; rows with a null vec_id link with nothing. Classes are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm._graph import components, crowded_join, spread_join
from marlow.llm._io import small_batches, written
from marlow.llm._repeats import whole_groups
from marlow.llm._words import mix
from marlow.llm.ngram_join import forest

THRESHOLD, TABLES, PROBES, SEED, BLOCK = 0.9, 12, 3, 0xC05, 1024
MISS = 1e-4
# Below, signs and Hadamard transforms give too few different rotations; these are drawn whole.
SMALL_DIMS = 16
# The sample that tables_for() hashes.
SAMPLE_PAIRS, SAMPLE_TABLES = 1500, 8
# Up to so many dimensions a rotation is applied as one matrix, itself made by Hadamard transforms; beyond them round by round.
DENSE_DIMS = 128
ROWS_AT_ONCE = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Of rows whose length is a power of two, without the factor."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def padded(dims: int) -> int:
    """The power of two, 2 at least, that vectors of so many components are filled up to."""
    return 1 << max(1, int(dims - 1).bit_length())


_made: dict[tuple[int, ...], np.ndarray] = {}


def rotated(x: np.ndarray, tables: int, width: int, seed: int) -> np.ndarray:
    """(rows, tables, width, dims): rows turned by every rotation of every table."""
    n, d = x.shape
    rng = np.random.default_rng([seed, d])
    if d <= DENSE_DIMS:
        key = (d, tables, width, seed)
        if key not in _made:
            turns = []
            for _ in range(tables * width):
                if d <= SMALL_DIMS:
                    turns.append(np.linalg.qr(rng.normal(size=(d, d)))[0])
                else:
                    turns.append(_rounds(np.eye(d), rng))
            _made.clear()
            _made[key] = np.concatenate(turns, 1)
        return (x @ _made[key]).reshape(n, tables, width, d)
    return np.stack([_rounds(x, rng) for _ in range(tables * width)], 1).reshape(n, tables, width, d)


def _rounds(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1])) / np.sqrt(x.shape[1])
    return x


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: int = 2, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) bucket codes of unit vectors; the first probe is the own bucket, the others by rising loss."""
    d = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    near = min(3, d)
    out = np.zeros((len(x), tables, probes), np.int64)
    for lo in range(0, len(x), ROWS_AT_ONCE):
        y = rotated(x[lo : lo + ROWS_AT_ONCE], tables, width, seed)
        size, best, top = np.abs(y), [], []
        for _ in range(near):
            at = size.argmax(3)[..., None]
            best.append(at)
            top.append(np.take_along_axis(size, at, 3))
            np.put_along_axis(size, at, -1.0, 3)
        order, top = np.concatenate(best, 3), np.concatenate(top, 3)
        vertex, gap = order * 2 + (np.take_along_axis(y, order, 3) < 0), (top[..., :1] - top) ** 2
        code, loss = np.zeros((len(y), tables, 1), np.int64), np.zeros((len(y), tables, 1))
        for w in range(width):
            code = (code[..., None] * (2 * d) + vertex[:, :, w, None, :]).reshape(len(y), tables, -1)
            loss = (loss[..., None] + gap[:, :, w, None, :]).reshape(len(y), tables, -1)
            least = np.argsort(loss, 2, kind="stable")[..., : max(probes, near)]
            code, loss = np.take_along_axis(code, least, 2), np.take_along_axis(loss, least, 2)
        k = min(probes, code.shape[2])
        out[lo : lo + len(y), :, :k] = code[..., :k]
        out[lo : lo + len(y), :, k:] = code[..., :1]
    return out


def bucket_keys(c: np.ndarray, dims: int) -> np.ndarray:
    """64-bit hashes of table, dimensions and code, of codes (rows, tables, probes)."""
    table = mix(np.arange(c.shape[1], dtype=np.uint64) << np.uint64(32) | np.uint64(dims))
    return mix(c.view(np.uint64) ^ table[:, None]).view(np.int64)


def width_for(rows: int, dims: int) -> int:
    """Vertices in a code: as many as leave ten buckets for each row, two at least."""
    return max(2, int(np.ceil(np.log(10 * max(rows, 1)) / np.log(2 * max(dims, 2)))))


def tables_for(dims: int, width: int, probes: int = PROBES, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables, TABLES at least, that leave `miss` of the pairs just at the threshold without a meeting, by the rate of one table on random pairs."""
    rng = np.random.default_rng([SEED, dims, width])
    a, b = rng.normal(size=(2, SAMPLE_PAIRS, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * b
    p, q = (codes(v, SAMPLE_TABLES, probes, width) for v in (a, b))
    met = ((p[:, :, :1] == q) | (q[:, :, :1] == p)).any(2).mean()
    if met == 0:
        raise ValueError(f"no pair at cosine {threshold} met in {SAMPLE_TABLES} tables of width {width}")
    return TABLES if met == 1 else max(TABLES, int(np.ceil(np.log(miss) / np.log(1 - met))))


def first_met(own: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether each pair meets here first: in no earlier table, and in no smaller code of this one. own: (rows, tables, probes)."""
    a, b = own[i, : table + 1], own[j, : table + 1]
    a_in, b_in = (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)
    before = (a_in | b_in)[:, :table].any(1)
    big = np.int64(2**62)
    least = np.minimum(np.where(a_in[:, table], a[:, table, 0], big), np.where(b_in[:, table], b[:, table, 0], big))
    return ~before & (least == code)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(vectors: pa.ChunkedArray, dims: np.ndarray, kind: type) -> np.ndarray:
    """Unit vectors from a column of their bytes, shorter ones with zeros behind."""
    raw = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] : np.frombuffer(c.buffers()[1], np.int32)[c.offset + len(c)]] for c in vectors.chunks if len(c)]).view(kind)
    out = np.zeros((len(dims), int(dims.max(initial=0))))
    out[np.arange(out.shape[1]) < dims[:, None]] = raw
    return _units(out)


def _distinct(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, weight, embedding): one row for each different vector that can link."""
    x = F.col("embedding")
    good = F.size(x) > 0
    good &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & good)
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).withColumn("node", F.xxhash64("embedding"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row of vec_id, embedding (array of float or double).

    Without a number of tables, as many as keep the recall at the width that the rows call for.
    """
    small_batches(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    distinct = written(_distinct(vectors), "vectors")
    rows_of: dict[int, int] = {}
    for size, n in distinct.groupBy(F.size("embedding")).count().collect():
        rows_of[padded(size)] = rows_of.get(padded(size), 0) + n
    shape = {}
    for d, n in rows_of.items():
        width = width_for(n, d)
        shape[d] = (tables or tables_for(d, width, probes, threshold), width)

    kind = np.float32 if dict(distinct.dtypes)["embedding"] == "array<float>" else np.float64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            size = np.diff(np.asarray(column.offsets))
            flat = column.flatten().to_numpy()
            first = np.append(0, np.cumsum(size))
            blob, own, keys = ([b""] * len(size) for _ in range(3))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                raw = flat[first[at][:, None] + np.arange(d)]
                count, width = shape[padded(int(d))]
                c = codes(_units(raw), count, probes, width)
                # vectors of other lengths lie in other buckets; the own ones first, then the others without repeats
                key = bucket_keys(c, int(d))
                for k, r in enumerate(at):
                    lives = key[k, :, 0]
                    more = np.unique(key[k, :, 1:])
                    blob[r], own[r], keys[r] = raw[k].astype(kind).tobytes(), c[k].tobytes(), np.append(lives, more[~np.isin(more, lives)])
            lists = pa.array([np.frombuffer(o, np.int64) if isinstance(o, bytes) else o for o in keys], pa.list_(pa.int64()))
            tables_of = pa.array([shape[padded(int(d))][0] for d in size], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), pa.array(size.astype(np.int32)), tables_of, pa.array(blob, pa.binary()), pa.array(own, pa.binary()), lists], ["node", "weight", "dims", "tables", "vector", "own", "keys"])

    signed = written(distinct.select("node", "weight", "embedding").mapInArrow(hashed, "node long, weight long, dims int, tables int, vector binary, own binary, keys array<long>"), "hashed")
    looks = signed.select("node", "tables", F.posexplode("keys").alias("at", "key")).select("node", "key", (F.col("at") < F.col("tables")).alias("lives"))
    buckets = looks.groupBy("key").agg(F.count("*").alias("n"), F.max("lives").alias("lived")).where("n > 1 and lived").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = written(crowded_join(looks, written(buckets, "buckets"), "key", "blocks", F.col("node")), "met")
    meet = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "lives")
    rows = meet.join(signed.select("node", "weight", "dims", "vector", "own").hint("merge"), "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp", lambda b: 64 * b.num_rows):
            grp, key, block, node, weight, lives, dims = (t.column(k).to_numpy() for k in ("grp", "key", "block", "node", "weight", "lives", "dims"))
            first, second = (t.column(k).to_numpy() for k in "ij")
            one_block = first == second
            x = _matrix(t.column("vector"), dims, kind)
            edge = np.append(np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in (grp, key, first, second)]))), len(grp))
            for lo, hi in zip(edge[:-1], edge[1:]):
                linked = np.triu(x[lo:hi] @ x[lo:hi].T >= threshold, 1)
                if not linked.any():
                    continue
                linked &= lives[lo:hi, None] | lives[lo:hi]
                if not one_block[lo]:
                    linked &= block[lo:hi, None] != block[lo:hi]
                i, j = np.nonzero(linked)
                if not len(i):
                    continue
                # a vector that lives here tells which table and code the bucket is
                home = np.frombuffer(t.column("own")[int(lo + np.flatnonzero(lives[lo:hi])[0])].as_buffer(), np.int64).reshape(1, -1, probes)[:, :, :1]
                table = int(np.flatnonzero(bucket_keys(np.ascontiguousarray(home), int(dims[lo]))[0, :, 0] == key[lo])[0])
                code = home[0, table, 0]
                rows_, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                own = np.stack([np.frombuffer(t.column("own")[lo + r].as_buffer(), np.int64) for r in rows_.tolist()]).reshape(len(rows_), -1, probes)
                for k in range(0, len(i), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    linked[i[part], j[part]] = first_met(own, at[: len(i)][part], at[len(i) :][part], table, code)
                linked |= linked.T
                links = linked @ weight[lo:hi]
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][hit]), pa.array(links[hit]), pa.array(node[lo:hi][forest(linked)[hit]])], ["node", "links", "peer"])

    rows = rows.withColumn("grp", F.xxhash64("key", "i", "j"))
    found = rows.repartition("grp").sortWithinPartitions("grp", "key", "i", "j", "node").mapInArrow(verify, "node long, links long, peer long")
    found = written(found, "links")
    tied = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    smallest = tied.join(distinct.select("node", "vec_id").hint("merge"), "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    about = distinct.select("node", F.col("vec_id").alias("copy_id"), "weight").join(found.groupBy("node").agg(F.sum("links").alias("links")).hint("merge"), "node", "left")
    about = about.join(spread_join(tied, smallest, "component", "node").select("node", "component_id").hint("merge"), "node", "left").where("weight > 1 or links is not null")
    named = vectors.withColumn("node", F.when(F.col("vec_id").isNotNull(), F.xxhash64("embedding"))).drop("embedding")
    out = spread_join(named, about, "node", "vec_id", "left")
    component = F.coalesce("component_id", "copy_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
