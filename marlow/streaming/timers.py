"""Per-key timers on streams: transformWithState with list state and event-time timers.

Rows may come late by the watermark's delay, in any batch and order: what is not settled yet waits in the key's list state,
sorted only when a timer fires, and a timer stands at the moment that settles it. So results are those of the whole
table in time order, up to the last watermark, whatever the batches. State is what is open: bursts, requests in flight or
records shown. It is kept by RocksDB, so it may be larger than a worker's memory; using() sets that for a query.

Keys are dealt by hash into buckets that share a list, a timer and a call of Python, whose cost would else be paid for
each key and each moment; a call holds the open items of one bucket. A checkpoint goes on with the number of buckets it began with.

Times are compared in microseconds; timers have milliseconds and stand at the next one.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 4096
# Keys that are structs, arrays or maps are held as JSON, times to the microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@contextmanager
def using(spark: SparkSession, **settings: str):
    """Queries started inside keep their state with RocksDB; the session's settings are as before afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, **settings}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Waiting(StatefulProcessor):
    """Keeps the items of a bucket's keys in a list, tuples of the key and `schema`; settle() splits a key's items when the timer fires.

    A timer stands at the first of the moments(item) still to come, or before it; one that fires settles all up to the watermark.
    """

    schema: str
    names: list[str]
    inputs: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.items = handle, handle.getListState("items", f"key string, {self.schema}")

    def moments(self, item: tuple) -> tuple[int, ...]:
        raise NotImplementedError

    def taken(self, items: list[tuple], rows: list[tuple]) -> list[tuple]:
        """A key's items with its new rows."""
        return items + rows

    def settle(self, items: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        """(results, items that stay) of a key at a watermark in microseconds."""
        raise NotImplementedError

    def _held(self) -> dict[str | None, list[tuple]]:
        out: dict[str | None, list[tuple]] = {}
        for k, *item in self.items.get() if self.items.exists() else ():
            out.setdefault(k, []).append(tuple(item))
        return out

    def _keep(self, held: dict[str | None, list[tuple]]) -> None:
        items = [(k, *i) for k, some in held.items() for i in some]
        self.items.put(items) if items else self.items.clear()

    def _first(self, items: Iterable[tuple], now: int) -> float:
        """The first moment after now, in milliseconds."""
        return min((-(-m // 1000) for i in items for m in self.moments(i) if m > now), default=math.inf)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str | None, list[tuple]] = {}
        for part in rows:
            for k, *row in part[self.inputs].itertuples(index=False, name=None):
                new.setdefault(k if isinstance(k, str) else None, []).append(tuple(row))
        if not new:
            return
        held = self._held()
        # the timer that is there
        at = self._first((i for some in held.values() for i in some), timerValues.getCurrentWatermarkInMs() * 1000)
        for k, some in new.items():
            held[k] = self.taken(held.get(k, []), some)
        self._keep(held)
        first = self._first((i for k in new for i in held[k]), -(1 << 62))
        if first < at:
            self.handle.registerTimer(first)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        held, out = self._held(), []
        for k, items in held.items():
            done, held[k] = self.settle(items, now)
            out += [(k, *d) for d in done]
        self._keep(held)
        first = self._first((i for some in held.values() for i in some), now)
        if first < math.inf:
            self.handle.registerTimer(first)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def _as_text(key: Column, kind: str) -> Column:
    if kind == "binary":
        return F.base64(key)
    return F.to_json(F.struct(key.alias("k")), _JSON) if kind.startswith(("struct", "array", "map")) else key.cast("string")


def _from_text(key: Column, kind: str) -> Column:
    if kind == "binary":
        return F.unbase64(key)
    return F.from_json(key, f"k {kind}", _JSON)["k"] if kind.startswith(("struct", "array", "map")) else key.cast(kind)


def _run(df: DataFrame, key: str, columns: list[Column], processor: _Waiting, schema: str, time: str, delay: str, buckets: int) -> DataFrame:
    """key and the columns of schema; micros come out as timestamps."""
    kind, named = dict(df.dtypes)[key], [f.strip().split()[0] for f in schema.split(",")]
    rows = df.withWatermark(time, delay).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket_row"), _as_text(F.col(key), kind).alias("key_row"), *columns, F.col(time).alias("event_row"))
    processor.names = ["key_row", *named]
    processor.inputs = [c for c in rows.columns if c not in ("bucket_row", "event_row")]
    out = rows.groupBy("bucket_row").transformWithStateInPandas(processor, f"key_row string, {schema}", "append", "eventTime")
    return out.select(_from_text(F.col("key_row"), kind).alias(key), *[F.timestamp_micros(c).alias(c[:-7]) if c.endswith("_micros") else F.col(c) for c in named])


class _Bursts(_Waiting):
    """Items: (begin, end, value at the end) of bursts, no two nearer than the gap."""

    schema = "begin long, end long, value double"

    def __init__(self, gap: int):
        self.gap = gap

    def moments(self, item: tuple) -> tuple[int, ...]:
        return (item[1] + self.gap,)

    def taken(self, items: list[tuple], rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for b, e, v in sorted(items + [(int(t), int(t), float(v)) for t, v in rows]):
            if out and b < out[-1][1] + self.gap:
                out[-1] = (out[-1][0], *max(out[-1][1:], (e, v)))
            else:
                out.append((b, e, v))
        return out

    def settle(self, items: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        return [(e, v) for _, e, v in items if e + self.gap <= now], [i for i in items if i[1] + self.gap > now]


def debounced(df: DataFrame, key: str, time: str, value: str, gap_ms: int, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """key, at, value: the last value of each burst of events, when nothing has followed it for the gap; of equal times the largest value."""
    schema = "at_micros long, value double"
    return _run(df, key, [F.unix_micros(time).alias("at_row"), F.col(value).cast("double").alias("value_row")], _Bursts(gap_ms * 1000), schema, time, delay, buckets)


class _Requests(_Waiting):
    """Items: (time, id, until) of requests that nothing newer has cancelled yet."""

    schema = "time long, id long, until long"

    def moments(self, item: tuple) -> tuple[int, ...]:
        # when it may cancel one before it, and when it is done
        return item[0], item[2]

    def taken(self, items: list[tuple], rows: list[tuple]) -> list[tuple]:
        return items + [(int(t), int(i), int(t) + int(n)) for t, i, n in rows]

    def settle(self, items: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        items, out, stay = sorted(items), [], []
        for k, (t, i, until) in enumerate(items):
            newer = items[k + 1][0] if k + 1 < len(items) else None
            # up to now all requests are known, so the next one is
            if newer is not None and newer <= now and newer < until:
                out.append((i, "cancelled", newer))
            elif until <= now:
                out.append((i, "done", until))
            else:
                stay.append((t, i, until))
        return out, stay


def answered(df: DataFrame, key: str, time: str, id_column: str, took_ms: str, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """key, id, state, at: each request is `done` after its time, or `cancelled` when a newer one of its key comes before that."""
    schema = "id long, state string, at_micros long"
    columns = [F.unix_micros(time).alias("at_row"), F.col(id_column).cast("long").alias("id_row"), (F.col(took_ms) * 1000).cast("long").alias("took_row")]
    return _run(df, key, columns, _Requests(), schema, time, delay, buckets)


class _Records(_Waiting):
    """Items: (time, until) of records, and (time, -1) of cancels."""

    schema = "time long, until long"

    def moments(self, item: tuple) -> tuple[int, ...]:
        return (max(item),)

    def taken(self, items: list[tuple], rows: list[tuple]) -> list[tuple]:
        return items + [(int(t), -1 if stop else int(t) + int(ms) * 1000) for t, ms, stop in rows if stop or ms > 0]

    def settle(self, items: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
        stops = sorted(t for t, u in items if u < 0)
        # a record with the first cancel from its time on in its time is kept
        open_ = [(t, u) for t, u in items if u >= 0 and not ((k := bisect_left(stops, t)) < len(stops) and stops[k] <= u)]
        # a cancel is done with when no record from before it can come any more
        return [i for i in open_ if i[1] <= now], [i for i in open_ if i[1] > now] + [(s, -1) for s in stops if s > now]


def expiring(df: DataFrame, key: str, time: str, timeout_ms: str, default_ms: int = 5000, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """key, shown, hidden: each record is hidden its timeout after it came; 0 never, negative or null the default, a `cancel` row while it is shown keeps it."""
    ms = F.when(F.coalesce(F.col(timeout_ms), F.lit(-1)) < 0, default_ms).otherwise(F.col(timeout_ms)).cast("long")
    schema = "shown_micros long, hidden_micros long"
    return _run(df, key, [F.unix_micros(time).alias("at_row"), ms.alias("ms_row"), F.coalesce("cancel", F.lit(False)).alias("stop_row")], _Records(), schema, time, delay, buckets)
