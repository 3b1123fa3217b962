"""Fuzzy search of many queries in many targets: the k best targets of each query, exactly, without scoring all of them.

Every word of a query must be found in a target, so a query goes by one of its words, its driver: the one that
stands as a whole in the fewest targets. Targets are met in two turns:

- The pieces of targets that begin as a word does are joined with the words. Targets that hold the same driver
  are packed into blocks, and a query is scored in the blocks of its driver alone.
- Any other target reads the driver with a gap, which costs 15 and another n / 2 for n characters more than the driver
  has, and a thousand times 15 if neither the driver nor the whole query can begin at a beginning of a word there. Queries
  for which the k-th score found doesn't exceed the former walk a trie of their drivers along the targets, from
  beginnings only if it exceeds the latter. The walk ends where a target lacks the next character, so it goes
  through matches and no other pairs; those whose lengths alone put them below the k-th score are not scored.

Scores are those of `marlow.functions.fuzzy`. Null and blank queries and null and empty targets give no rows; equal
queries and equal targets are searched once, whatever number of rows has them, so results are joined back by text.
Ties go to the smaller text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlow.functions import fuzzy
from marlow.sources.shared import written

# Texts and characters of a block, about; queries that share one; characters of a word that the join goes by.
BLOCK_ROWS, BLOCK_CHARS, SHARERS, KEY = 512, 1 << 18, 1000, 8
# Pairs of a query and a block that a task scores, about.
TASK_PAIRS = 250
# The least that a reading with a gap costs: 12, the gap, and the place behind it, which is 2 or more; and the factor for one that begins at no beginning.
GAP, LOOSE = 15.0, 1000.0
# A walk takes so many queries, and targets of about so many characters, in LEAST_SLICES slices or more.
WALK_QUERIES, SLICE_CHARS, LEAST_SLICES = 50_000, 1 << 21, 8
# Entries of a batch's table of next places; steps that are taken at once.
CELLS, STEPS = 1 << 24, 1 << 19
EPS = 1e-9


def _plain(text: str) -> str:
    return fuzzy.without_accents(text).lower()


def targets_of(targets: DataFrame, column: str) -> DataFrame:
    """(target): the different texts."""
    return targets.select(F.col(column).alias("target")).where("target <> ''").distinct()


def queries_of(queries: DataFrame, column: str) -> DataFrame:
    """(q, phrase, words): the different queries, as they are read."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q in b["q"]:
                phrase = _plain(q.strip())
                words = fuzzy.words_of(q) if " " in phrase else [phrase]
                if phrase and words:
                    rows.append((q, phrase, words))
            if rows:
                yield pd.DataFrame(rows, columns=["q", "phrase", "words"])

    some = queries.select(F.col(column).alias("q")).where(F.length(F.trim("q")) > 0).distinct()
    return some.mapInPandas(ask, "q string, phrase string, words array<string>")


def pieces_of(targets: DataFrame, lengths: list[int]) -> DataFrame:
    """(target, piece): the different pieces of these lengths of each target."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some, pieces = [], []
            for t in b["target"]:
                p = _plain(t)
                found = {p[i : i + n] for n in lengths for i in range(len(p) - n + 1)}
                some += [t] * len(found)
                pieces += found
                if len(some) > STEPS:
                    yield pd.DataFrame({"target": some, "piece": pieces})
                    some, pieces = [], []
            if some:
                yield pd.DataFrame({"target": some, "piece": pieces})

    return targets.mapInPandas(cut, "target string, piece string")


def driven(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(q, phrase, words, driver, n): each query's word whose beginning the fewest targets hold, the longest of such, and how many they are.

    held: (target, piece) of the beginnings of words.
    """
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    words = asked.select("q", F.explode("words").alias("w")).withColumn("piece", F.substring("w", 1, KEY)).join(counts, "piece", "left")
    rarest = words.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("w")).alias("m"), F.col("w").alias("driver"))).alias("r"))
    return asked.join(rarest.select("q", "r.driver", "r.n"), "q")


def blocks_of(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(block, piece, turn, turns, texts): the targets that hold the beginning of some driver, in blocks; those with many queries once for each turn of these."""
    sharers = asked.where("n > 0").groupBy(F.substring("driver", 1, KEY).alias("piece")).agg(F.ceil(F.count("*") / SHARERS).alias("turns"))
    sizes = held.groupBy("piece").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("target")) / BLOCK_CHARS)).alias("parts")).join(sharers, "piece")
    parts = held.join(sizes, "piece").withColumn("part", F.pmod(F.xxhash64("target"), "parts"))
    packed = parts.groupBy("piece", "turns", "part").agg(F.collect_list("target").alias("texts")).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    return packed.select(F.concat_ws(" ", "piece", "part", "turn").alias("block"), "piece", "turn", "turns", "texts")


def pairs_of(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(q, block): the queries with the blocks of their drivers."""
    turns = blocks.select("piece", "turns").distinct()
    some = asked.where("n > 0").select("q", F.substring("driver", 1, KEY).alias("piece")).join(turns, "piece")
    return some.withColumn("turn", F.pmod(F.xxhash64("q"), "turns")).join(blocks.select("piece", "turn", "block"), ["piece", "turn"]).select("q", "block")


def scored(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(q, target, raw): the k best targets of each pair of a query and a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, pieces = None, []
        for b in batches:
            out = []
            for q, block, texts in zip(b["q"], b["block"], b["texts"]):
                if block != name:
                    name = block
                    pieces = [(some, fuzzy.Targets(some)) for _, (some,) in fuzzy._pieces(pd.Series(list(texts)))]
                found = []
                for some, targets in pieces:
                    score = fuzzy.search(q, targets)[0]
                    found += [(-score[r], some[r]) for r in np.flatnonzero(score > fuzzy.NEVER)]
                out += [(q, t, -s) for s, t in sorted(found)[:k]]
            if out:
                yield pd.DataFrame(out, columns=["q", "target", "raw"])

    # a number of tasks by the work, which is not seen from the size of the rows
    n = max(1, -(-pairs.count() // TASK_PAIRS))
    met = pairs.repartition(n, "block").join(blocks.select("block", "texts").repartition(n, "block"), "block")
    return met.select("q", "block", "texts").sortWithinPartitions("block").mapInPandas(run, "q string, target string, raw double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("raw"), "target")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floor(found: DataFrame, k: int) -> DataFrame:
    """(q, floor): the k-th best score of a query, where k are found."""
    return best(found, k).where(F.col("rank") == k).select("q", F.col("raw").alias("floor"))


def _bound(cost: float, least: int) -> Column:
    """The best score in a target that doesn't hold the driver, of `least` characters or more, if a reading with a gap costs so much."""
    behind = lambda w: F.greatest(F.lit(least) - F.length(w), F.lit(0)) / 2
    rest = F.aggregate("words", F.lit(0.0), lambda a, w: a - behind(w))
    return F.greatest((rest - cost - behind("driver")) / F.size("words"), -cost - 2 * behind("phrase")) + EPS


class Trie:
    """Different words. Node 0 is the root; node n has the children child[first[n]:first[n + 1]], reached by the characters there; ends[n] is the word that ends at n, or -1."""

    def __init__(self, words: list[str]):
        below: list[dict[str, int]] = [{}]
        ends = [-1]
        for n, w in enumerate(words):
            at = 0
            for c in w:
                to = below[at].get(c)
                if to is None:
                    to = below[at][c] = len(below)
                    below.append({})
                    ends.append(-1)
                at = to
            ends[at] = n
        self.chars = sorted({c for node in below for c in node})
        number = {c: n for n, c in enumerate(self.chars)}
        self.first = np.cumsum([0] + [len(node) for node in below])
        self.child = np.array([to for node in below for to in node.values()], np.int64)
        self.char = np.array([number[c] for node in below for c in node], np.int64)
        self.ends = np.array(ends)

    def walk(self, targets: fuzzy.Targets, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, row) of the words whose characters stand in a target in order, the first one at a place of `starts`."""
        there = set(np.unique(targets.code).tolist())
        some = [n for n, c in enumerate(self.chars) if ord(c) in there]
        width = targets.code.shape[1]
        # where each character stands next, by character, row and place; the last table is of those that stand nowhere
        after = np.full((len(some) + 1, *targets.code.shape), width, np.int32)
        begin = after.copy()
        which = np.full(len(self.chars), len(some))
        for n, c in enumerate(some):
            hit = targets.code == ord(self.chars[c])
            after[n], begin[n] = fuzzy._first(hit), fuzzy._first(hit & starts)
            which[c] = n
        rows = np.arange(len(targets.size))
        todo = [(np.zeros(len(rows), np.int64), rows, np.zeros(len(rows), np.int64))]
        while todo:
            node, row, at = todo.pop()
            n = self.first[node + 1] - self.first[node]
            total = np.cumsum(n)
            if len(node) > 1 and total[-1] > STEPS:
                half = max(1, min(len(node) - 1, int(np.searchsorted(total, STEPS))))
                todo += [(node[half:], row[half:], at[half:]), (node[:half], row[:half], at[:half])]
                continue
            each = np.repeat(np.arange(len(node)), n)
            edge = np.arange(len(each)) - (total - n)[each] + self.first[node][each]
            to, row, at = self.child[edge], row[each], at[each]
            table = np.where(node[each] == 0, begin[which[self.char[edge]], row, at], after[which[self.char[edge]], row, at])
            ok = table < width
            to, row, at = to[ok], row[ok], table[ok].astype(np.int64) + 1
            end = self.ends[to]
            if (end >= 0).any():
                yield end[end >= 0], row[end >= 0]
            if len(to):
                todo.append((to, row, at))


def _starts(targets: fuzzy.Targets, before: list[int]) -> np.ndarray:
    """Where words may begin if what was read of others may end with the characters `before`."""
    out = targets.begins.copy()
    out[:, 1:] |= np.isin(targets.code[:, :-1], before)
    return out


def walked(asked: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(q, target, raw): the k best of each slice of the targets that can reach the floors and don't hold the driver's beginning.

    asked: (q, phrase, words, driver, loose, floor); loose: whether readings that begin at no beginning can reach the floor.
    """

    def run(asked: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[tuple[float, str]]] = {}
        if not len(asked) or not len(texts):
            return pd.DataFrame({"q": np.array([], object), "target": np.array([], object), "raw": np.array([], float)})
        asked = asked.sort_values("q", ignore_index=True)
        before = sorted({ord(w[-1]) for words in asked["words"] for w in words[:-1]})
        tries = []
        for loose in (False, True):
            of: dict[str, list[int]] = {}
            for n in np.flatnonzero(asked["loose"].to_numpy(bool) == loose):
                # the whole query may begin at a beginning where its driver doesn't
                for w in {asked["driver"][n]} if loose else {asked["driver"][n], asked["phrase"][n]}:
                    of.setdefault(w, []).append(int(n))
            if of:
                n_of = np.array([len(x) for x in of.values()])
                tries.append((loose, Trie(list(of)), np.cumsum(n_of) - n_of, n_of, np.concatenate([np.array(x) for x in of.values()])))
        n_words = asked["words"].map(len).to_numpy()
        n_all = asked["words"].map(lambda words: sum(map(len, words))).to_numpy()
        n_driver, n_phrase = asked["driver"].str.len().to_numpy(), asked["phrase"].str.len().to_numpy()
        floor = asked["floor"].fillna(fuzzy.NEVER).to_numpy(float)
        chars = max(len(t.chars) for _, t, *_ in tries)
        for some in _batches(texts["target"], chars + 1):
            ready, plain = fuzzy.Targets(some), [_plain(t) for t in some]
            pairs = []
            for loose, trie, first, n_of, queries in tries:
                starts = np.ones(ready.code.shape, bool) if loose else _starts(ready, before)
                for word, row in trie.walk(ready, starts):
                    n = n_of[word]
                    each = np.repeat(np.arange(len(word)), n)
                    q = queries[np.arange(len(each)) - (np.cumsum(n) - n)[each] + first[word[each]]]
                    row = row[each]
                    size = ready.size[row]
                    # a word isn't longer than a target that it matches; the sum bounds that of the positive differences from below
                    reach = np.maximum((-GAP - np.maximum(size * n_words[q] - n_all[q], 0) / 2 - (size - n_driver[q]) / 2) / n_words[q], -GAP - np.maximum(size - n_phrase[q], 0)) + EPS
                    ok = reach >= floor[q]
                    pairs.append(np.unique(np.stack([q[ok], row[ok]], 1), axis=0))
            if not pairs:
                continue
            both = np.unique(np.concatenate(pairs), axis=0)
            edge = np.append(np.flatnonzero(np.diff(both[:, 0], prepend=-1)), len(both))
            for lo, hi in zip(edge[:-1], edge[1:]):
                n = both[lo, 0]
                q, key = asked["q"][n], asked["driver"][n][:KEY]
                left = [some[r] for r in both[lo:hi, 1] if key not in plain[r]]
                if left:
                    score = fuzzy.search(q, fuzzy.Targets(left))[0]
                    found = [(-score[r], left[r]) for r in np.flatnonzero(score > fuzzy.NEVER)]
                    out[q] = sorted(out.get(q, []) + found)[:k]
        return pd.DataFrame([(q, t, -s) for q, found in out.items() for s, t in found], columns=["q", "target", "raw"]).astype({"q": object, "target": object, "raw": float})

    n, chars = asked.count(), targets.agg(F.sum(F.length("target"))).first()[0]
    parts, slices = -(-n // WALK_QUERIES), max(LEAST_SLICES, -(-(chars or 0) // SLICE_CHARS))
    of = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(max(m, 1) - 1)))
    tasks = max(parts, 1) * slices
    left = asked.withColumn("part", of("q", max(parts, 1))).withColumn("slice", each(slices)).repartition(tasks, "part", "slice")
    right = targets.withColumn("slice", of("target", slices)).withColumn("part", each(parts)).repartition(tasks, "part", "slice")
    return left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInPandas(run, "q string, target string, raw double")


def _batches(texts: pd.Series, chars: int) -> Iterator[list[str]]:
    """Texts of similar lengths, as many as a table of this number of characters takes."""
    order = texts.iloc[np.argsort(texts.str.len().to_numpy(), kind="stable")].tolist()
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (len(order[to]) + 2) * chars <= CELLS:
            to += 1
        yield order[at:to]
        at = to


def fuzzy_join(queries: DataFrame, targets: DataFrame, query: str, target: str, k: int = 10) -> DataFrame:
    """(query, target, raw, rank): of each different query the k best different targets, fewer if fewer match."""
    texts, asked = written(targets_of(targets, target), "targets"), written(queries_of(queries, query), "asked")
    words = asked.select(F.explode("words").alias("w")).select(F.substring("w", 1, KEY).alias("piece")).distinct()
    lengths = sorted(r.n for r in words.select(F.length("piece").alias("n")).distinct().collect())  # KEY at most
    held = written(pieces_of(texts, lengths).join(words, "piece"), "held")
    asked = written(driven(asked, held), "asked")
    blocks = written(blocks_of(held, asked), "blocks")
    pairs = written(pairs_of(asked, blocks), "pairs")
    one = written(scored(pairs, blocks, k), "found")
    least = texts.agg(F.min(F.length("target"))).first()[0] or 0
    # without accents a text may be shorter, by marks that stand alone
    least = 0 if texts.where("target rlike '[^\\\\x00-\\\\x7F]'").limit(1).count() else least
    open_ = asked.where(F.length("driver") > 1).join(_floor(one, k), "q", "left").withColumn("loose", F.expr("floor is null") | (_bound(GAP * LOOSE, least) >= F.col("floor")))
    open_ = written(open_.where(F.col("loose") | (_bound(GAP, least) >= F.col("floor"))), "open")
    out = best(one.unionByName(walked(open_, texts, k)), k)
    return out.select(F.col("q").alias("query"), "target", "raw", "rank")
