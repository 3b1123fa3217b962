"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

Training is backpropagation through time in numpy, on a bounded sample of labelled texts that is
gathered on the driver: TEXTS_PER_LABEL rows of each of the MOST_LABELS most frequent labels, each cut
to TEXT_CHARS. Prediction cuts each whole text into spans of SPAN bytes, labels every byte position by
the states of both directions, and pools the positions' probabilities; a text of any length is read
whole, COLUMNS spans at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlow.llm._io import small_batches
from marlow.llm._words import utf8

UNITS = 8
SPAN = 128
COLUMNS = 2048
UNDETERMINED = "und"
# The bounds of the training sample: so many labels, texts of each, chosen by a hash of doc_id, and characters of each text.
MOST_LABELS, TEXTS_PER_LABEL, TEXT_CHARS = 256, 150, 20_000
# keep_identified() rejects a text whose best label has a smaller pooled probability, or with many labels one under OVER_CHANCE times an even share.
LEAST, OVER_CHANCE = 0.3, 2.0
STEPS, BATCH, TRAIN_SPAN, SEED = 260, 96, 64, 11


@dataclass
class Model:
    """labels; of each direction byte inputs (3U x 256) and state weights (3U x U), rows update, reset, new; output (K x 2U) and bias."""

    labels: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.out, self.bias]


def _start(labels: list[str], units: int, rng: np.random.Generator) -> Model:
    normal = lambda *shape: rng.normal(0, 0.35, shape).astype(np.float32)
    return Model(labels, [normal(3 * units, 256) for _ in "fb"], [normal(3 * units, units) for _ in "fb"], normal(len(labels), 2 * units), np.zeros((len(labels), 1), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _step(x: np.ndarray, u: np.ndarray, h: np.ndarray):
    """One position: gates (update, reset), the reset's share of the state, the new value, the next state."""
    n = len(h)
    s = u @ h
    gates = x[: 2 * n] + s[: 2 * n]
    _sigmoid(gates)
    new = gates[n:] * s[2 * n :]
    new += x[2 * n :]
    np.tanh(new, out=new)
    nxt = h - new
    nxt *= gates[:n]
    nxt += new
    return gates, s[2 * n :], new, nxt


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits


def gradients(m: Model, codes: np.ndarray, want: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of codes (T x B) for labels want (B), and its gradients by weights()."""
    t_n, b_n = codes.shape
    n = m.u[0].shape[1]
    kept: list[list] = [[], []]
    states = np.zeros((2, t_n, n, b_n), m.out.dtype)
    for d, order in enumerate((range(t_n), range(t_n - 1, -1, -1))):
        h = np.zeros((n, b_n), m.out.dtype)
        for t in order:
            gates, s, new, nxt = _step(m.x[d][:, codes[t]], m.u[d], h)
            kept[d].append((t, h, gates, s, new))
            states[d, t] = h = nxt
    both = states.transpose(1, 0, 2, 3).reshape(t_n, 2 * n, b_n)
    p = np.stack([_softmax(m.out @ both[t] + m.bias) for t in range(t_n)])
    loss = float(-np.log(p[:, want, np.arange(b_n)] + 1e-12).mean())
    p[:, want, np.arange(b_n)] -= 1
    p /= t_n * b_n
    g_out = np.einsum("tkb,thb->kh", p, both)
    g_bias = p.sum((0, 2))[:, None]
    g_x, g_u = [np.zeros_like(x) for x in m.x], [np.zeros_like(u) for u in m.u]
    for d in (0, 1):
        back = np.zeros((n, b_n), m.out.dtype)
        for t, h, gates, s, new in reversed(kept[d]):
            dh = m.out[:, d * n : (d + 1) * n].T @ p[t] + back
            update, reset = gates[:n], gates[n:]
            d_new = dh * (1 - update) * (1 - new * new)
            d_in = np.concatenate([dh * (h - new) * update * (1 - update), d_new * s * reset * (1 - reset), d_new])
            d_state = d_in.copy()
            d_state[2 * n :] *= reset
            g_u[d] += d_state @ h.T
            np.add.at(g_x[d].T, codes[t], d_in.T)
            back = dh * update + m.u[d].T @ d_state
    return loss, [*g_x, *g_u, g_out, g_bias]


def fit(texts: list[tuple[str, str]], units: int = UNITS, steps: int = STEPS, seed: int = SEED) -> Model:
    """Adam on random spans of the texts, as many of each label; (label, text) in, empty texts are passed over."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[np.ndarray]] = {}
    for label, text in sorted(texts):
        if text:
            by.setdefault(label, []).append(np.frombuffer(text.encode(), np.uint8))
    labels = sorted(by)
    m = _start(labels, units, rng)
    if not labels:
        return m
    first, second = ([np.zeros_like(w) for w in m.weights()] for _ in "12")
    for step in range(1, steps + 1):
        want = rng.permutation(np.arange(BATCH) % len(labels))
        codes = np.zeros((TRAIN_SPAN, BATCH), np.intp)
        for b, k in enumerate(want):
            own = by[labels[k]]
            raw = own[rng.integers(len(own))]
            at = rng.integers(max(1, len(raw) - TRAIN_SPAN + 1))
            part = raw[at : at + TRAIN_SPAN]
            codes[: len(part), b] = part
        _, grads = gradients(m, codes, want)
        rate = 0.03 * (1 - step / (steps + 1))
        for w, g, a, b in zip(m.weights(), grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def sample(docs: DataFrame, per_label: int = TEXTS_PER_LABEL) -> list[tuple[str, str]]:
    """(lang, text) of at most per_label rows of each of the most frequent labels, by a hash of doc_id, texts cut to TEXT_CHARS.

    ids are chosen first, without texts. Rows that share an id are no more than others: the bound is of rows.
    """
    rows = docs.where("lang is not null and doc_id is not null and text is not null")
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).select("lang")
    labels = [r[0] for r in frequent.collect()]
    if not labels:
        return []

    def first(df: DataFrame, *ties: str) -> DataFrame:
        order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", *ties)
        return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label)

    rows = rows.where(F.col("lang").isin(labels))
    ids = [r[0] for r in first(rows.select("lang", "doc_id")).select("doc_id").collect()]
    cut = rows.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", F.substring("text", 1, TEXT_CHARS).alias("text"))
    return [tuple(r) for r in first(cut, "text").select("lang", "text").collect()]


def pooled(m: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all byte positions of each text (rows; zeros for empty ones)."""
    size = np.diff(offsets)
    spans = -(-size // SPAN)
    text = np.repeat(np.arange(len(size)), spans)
    at = offsets[text] + SPAN * (np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans))
    total = np.zeros((len(size), len(m.labels)))
    n = m.u[0].shape[1]
    padded = np.append(data, np.zeros(SPAN, np.uint8))
    for lo in range(0, len(text), COLUMNS):
        own, begin = text[lo : lo + COLUMNS], at[lo : lo + COLUMNS]
        left = offsets[own + 1] - begin
        codes = padded[begin[:, None] + np.arange(SPAN)]
        codes[np.arange(SPAN) >= left[:, None]] = 0
        codes = np.ascontiguousarray(codes.T).astype(np.intp)
        forward = np.empty((SPAN, n, len(own)), np.float32)
        h = np.zeros((n, len(own)), np.float32)
        for t in range(SPAN):
            h = forward[t] = _step(m.x[0].take(codes[t], 1), m.u[0], h)[3]
        h = np.zeros((n, len(own)), np.float32)
        sums = np.zeros((len(m.labels), len(own)))
        for t in range(SPAN - 1, -1, -1):
            h = _step(m.x[1].take(codes[t], 1), m.u[1], h)[3]
            p = _softmax(m.out[:, :n] @ forward[t] + m.out[:, n:] @ h + m.bias)
            p *= t < left
            sums += p
        np.add.at(total, own, sums.T)
    return total / np.maximum(size, 1)[:, None]


def predict(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row; `und` and 0 where the text is null or has no letter, or nothing was learned."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lettered = np.array([any(map(str.isalpha, t.as_py() or "")) for t in b.column(1)], bool)
            lettered &= bool(m.labels)
            p = pooled(m, *utf8(b.column(1))) if m.labels else np.zeros((b.num_rows, 1))
            best = p.argmax(1)
            names = [m.labels[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)]
            score = np.where(lettered, np.round(np.clip(p[np.arange(len(p)), best], 0, 1), 6), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def held_out() -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2. Null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out."""
    m = fit(sample(docs.where(~held_out())))
    return predict(docs, m).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def least_of(labels: int, least: float = LEAST) -> float:
    """The pooled probability that the best of so many labels needs."""
    return min(least, OVER_CHANCE / max(labels, 1))


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without those that have no language: null or without a letter, or the best label's pooled probability is under `least`.

    Probabilities are shared out among all labels, so from seven labels on the bound falls to twice an even share.
    Where nothing could be learned, as no row has a label, only those without a letter go.
    """
    small_batches(docs.sparkSession)
    m = fit(sample(docs.where(~held_out())))
    at, bound = docs.columns.index("text"), least_of(len(m.labels), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            p = pooled(m, *utf8(texts)).max(1) if m.labels else np.ones(b.num_rows)
            keep = [bool(s >= bound) and any(map(str.isalpha, t.as_py() or "")) for s, t in zip(p, texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
