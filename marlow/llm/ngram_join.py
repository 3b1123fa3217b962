"""Similarity join on word n-gram sets: MinHash banding proposes, full sets verify.

Texts of one word sequence are one class and are represented once. Bands and rows follow from the
target recall at the threshold. Classes that share a band hash become star edges to the smallest of
their bucket, never all pairs. Full n-gram sets verify every pair that shares a band, and no other,
whatever is around it. Only where the sets meet follows from sizes: in their component, each set
copied once where that is small; one over BLOCK classes is verified by its buckets instead where these
are smaller (a chain of texts that resemble their neighbours alone), a pair in the first band it
shares. Groups over BLOCK are dealt out as pairs of blocks of bounded size, which return link counts
and a spanning forest instead of pairs.

Defined cases: a null text or one without words has no n-grams and links with nothing; a text of
fewer words than n has one n-gram, all its words; rows with a null doc_id link with nothing; rows
that share a doc_id are judged each by its text. Classes are told apart by 64 bits of BLAKE2b over the
word sequence, n-grams by 64-bit hashes of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.llm._graph import components, spread_join
from marlow.llm._io import small_batches, written
from marlow.llm._words import gram_hashes, mix, pieces, text_digests, utf8, word_hashes, words

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
BLOCK = 128
_rng = np.random.default_rng(0xBA9D)
_SEED, _ODD = _rng.integers(0, 2**64, 4096, dtype=np.uint64), _rng.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)


def bands_and_rows(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band for which enough bands to find a pair at the threshold with probability `recall` need at most `most` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit > 1e-12 else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """n-gram hashes of a few texts, with each text's first n-gram (one more at the end), and the texts' digests."""
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    digests, _ = text_digests(data, offsets)
    grams = gram_hashes(hashes, n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(grams)) + n <= first[text[: len(grams)] + 1])
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    owner = np.concatenate([text[at], short])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([grams[at], digests[short]])[order], np.searchsorted(owner[order], np.arange(len(first))), digests


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, keys): node is the class, keys one hash for each band; node and keys are null without n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for lo, hi in pieces(np.diff(offsets), 1 << 20):
                grams, first, digests = gram_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                some = np.diff(first) > 0
                at = first[:-1][some]
                keys = np.zeros((int(some.sum()), bands), np.uint64)
                for k in range(bands if len(at) else 0):
                    key = np.full(len(at), k + 1, np.uint64)
                    for r in range(k * rows, k * rows + rows):
                        key = mix(key ^ np.minimum.reduceat((grams ^ _SEED[r]) * _ODD[r], at))
                    keys[:, k] = key
                mask = pa.array(~some)
                full = np.zeros(len(some) + 1, np.int32)
                np.cumsum(some * bands, out=full[1:])
                lists = pa.ListArray.from_arrays(pa.array(full), pa.array(keys.ravel().view(np.int64)))
                node = pa.array(digests.view(np.int64), mask=~some)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), node, pa.array([None] * len(lists), lists.type) if mask.true_count == len(mask) else lists], ["doc_id", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, keys array<long>")


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows equal in `by`, from batches sorted by it; a group has a bounded number of rows by design."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in by], 1)
        cuts = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, b.num_rows)
        at = 0
        for cut in cuts:
            key = tuple(keys[at])
            if held and key != last:
                yield held
                held = []
            held.append(b.slice(at, cut - at))
            last, at = key, cut
    if held:
        yield held


def forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row it is connected with."""
    label = np.arange(len(links))
    linked = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(links)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of the incidence matrix, some columns at a time."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = count[column] > 1
    row, column = row[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    width = 8192
    for lo in range(0, int((count > 1).sum()), width):
        a, z = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:z], column[a:z] - lo] = 1
        total += m @ m.T
    return total


def met(keys: np.ndarray, i: np.ndarray, j: np.ndarray, key: int | None) -> np.ndarray:
    """Whether each pair of rows shares a band; where a key is given, whether the first band shared is the one with this key."""
    same = keys[i] == keys[j]
    at = same.argmax(1)
    shared = same[np.arange(len(i)), at]
    return shared if key is None else shared & (keys[i, at] == key)


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, links, peer): of rows grp, i, j, block, node, weight, keys, banded, grams, the summed weights of linked nodes and a forest.

    keys: the bands of a class; banded: the group is the bucket of one band, else a component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("grp", "i", "j")):
            take = lambda k: np.concatenate([g.column(k).to_numpy() for g in group])  # noqa: E731, B023
            block, node, weight = take("block"), take("node"), take("weight")
            grp, i, j = (group[0].column(k)[0].as_py() for k in ("grp", "i", "j"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for g in group for x in g.column("grams")]
            size = np.array([len(s) for s in sets], float)
            both = _overlaps(sets)
            linked = both >= threshold * (size[:, None] + size - both) - 1e-9
            linked &= (block[:, None] != block) if i != j else ~np.eye(len(sets), dtype=bool)
            keys = np.concatenate([g.column("keys").flatten().to_numpy() for g in group]).reshape(len(sets), -1)
            p, q = np.nonzero(linked)
            linked[p, q] = met(keys, p, q, grp if group[0].column("banded")[0].as_py() else None)
            peer = node[forest(linked)]
            links = linked @ weight
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(peer[hit])], ["node", "links", "peer"])

    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node").mapInArrow(run, "node long, links long, peer long")


def _cost(n: F.Column) -> F.Column:
    """Copies of sets that a group of n classes takes."""
    return n * F.ceil(n / BLOCK)


def groups_of(near: DataFrame, in_band: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, node, weight, grps array<struct<grp, blocks>>, keys, banded): the groups in which each class is verified: its component, or its buckets."""
    size = near.groupBy("component").agg(F.count("*").alias("n"))
    big = spread_join(near, size.where(F.col("n") > BLOCK), "component", "node")
    bucket = in_band.join(big.select("node", "component").hint("merge"), "node").groupBy("key", "component").agg(F.count("*").alias("k")).where("k > 1")
    split = bucket.groupBy("component").agg(F.sum(_cost(F.col("k"))).alias("cost")).join(size.hint("merge"), "component").where(F.col("cost") < _cost(F.col("n"))).select("component", F.lit(True).alias("split"))
    decided = spread_join(near, size.join(split.hint("merge"), "component", "left"), "component", "node").join(classes.select("node", "doc_id", "weight", "keys").hint("merge"), "node")
    one = F.array(F.struct(F.col("component").alias("grp"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    whole = decided.where("split is null").select("doc_id", "node", "weight", one.alias("grps"), "keys", F.lit(False).alias("banded"))
    own = decided.where("split").select("doc_id", "node", "weight", "keys", F.explode("keys").alias("key"))
    blocks = bucket.select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    by_band = spread_join(own, blocks, "key", "node").groupBy("doc_id", "node", "weight", "keys").agg(F.collect_list(F.struct(F.col("key").alias("grp"), "blocks")).alias("grps"))
    return whole.unionByName(by_band.select("doc_id", "node", "weight", "grps", "keys", F.lit(True).alias("banded")))


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_id, n_links, kept: one row per input row.

    n_links: other rows whose n-gram set has Jaccard similarity >= threshold; class_id: the smallest
    doc_id reachable over links; copy_id: the smallest doc_id of the same word sequence; kept:
    doc_id is class_id.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    bands, rows = bands_and_rows(threshold, recall)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    judged = signed.where("node is not null and doc_id is not null")
    classes = written(judged.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"), F.first("keys").alias("keys")), "classes")
    in_band = classes.select("node", F.explode("keys").alias("key"))
    bucket = in_band.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    stars = in_band.join(bucket, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    near = written(groups_of(components(stars), in_band, classes), "near")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "weight", "grps", "keys", "banded", "grams"]
        for b in batches:
            data, offsets = utf8(b.column("text"))
            want = b.column("node").to_numpy()
            for lo, hi in pieces(np.diff(offsets)):
                grams, first, digests = gram_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                own = np.flatnonzero(digests.view(np.int64) == want[lo:hi])  # rows that share a doc_id have other texts
                blobs = [np.unique(grams[first[k] : first[k + 1]]).tobytes() for k in own]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(lo + own)) for c in names[:-1]], pa.array(blobs, pa.binary())], names)

    picked = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(near.hint("merge"), "doc_id")
    full = picked.select("node", "weight", "grps", "keys", "banded", "text").mapInArrow(sets, "node long, weight long, grps array<struct<grp:bigint,blocks:int>>, keys array<long>, banded boolean, grams binary")
    full = full.withColumn("g", F.explode("grps")).select("g.*", "node", "weight", "keys", "banded", "grams")
    full = full.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = full.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "keys", "banded", "grams")
    links = written(verified(dealt, threshold), "links")
    tied = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    smallest = tied.join(classes.select("node", "doc_id").hint("merge"), "node").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))
    about = classes.select("node", F.col("doc_id").alias("copy_id"), "weight").join(linked.hint("merge"), "node", "left").join(spread_join(tied, smallest, "component", "node").select("node", "class_id").hint("merge"), "node", "left")
    # single texts without links need no join
    about = about.where("weight > 1 or links is not null")
    out = spread_join(signed.select("doc_id", "node"), about, "node", "doc_id", "left")
    judged = F.col("copy_id").isNotNull() & F.col("doc_id").isNotNull()
    class_id = F.when(judged, F.coalesce("class_id", "copy_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.when(judged, F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"), F.when(judged, F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of linked ones, the smallest doc_id; rows with a null id or no words stay.

    Rows that share a doc_id stay together if one of them stays.
    """
    gone = written(ngram_join(docs, n, threshold).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
