"""Timers on streams: late rows, batches in any cut, and a restart in the middle give what the whole table gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlow.plans.source_queries import drained
from marlow.streaming import timers

START = dt.datetime(2024, 1, 1)
FAR = 1_000_000  # seconds, so that everything before is settled


def at(seconds):
    return START + dt.timedelta(milliseconds=round(seconds * 1000))


class Feed:
    """A folder into which parts are put one after the other, and a stream over it whose checkpoint stays."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        (folder / "in").mkdir()

    def put(self, rows):
        n = len(list((self.folder / "in").iterdir()))
        # one file for each part, read in the order of names' times
        part = self.folder / f"part{n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(self.folder / "in" / f"{n:03}.parquet")

    def run(self, make):
        s = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        with timers.using(self.spark):
            q = make(s).writeStream.outputMode("append").format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted(tuple(r) for r in self.spark.read.parquet(str(self.folder / "out")).collect())


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path, schema)


def parts(rows, late, n, seed=3):
    """Rows in n parts, each row at most `late` seconds behind its place; then two rows far ahead."""
    r = random.Random(seed)
    order = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=r.random() * late))
    step = -(-len(order) // n)
    return [order[k : k + step] for k in range(0, len(order), step)]


def bursts(rows, gap):
    out, open_ = [], {}
    for k, t, v in sorted(rows):
        if k in open_ and t < open_[k][0] + dt.timedelta(seconds=gap):
            open_[k] = max(open_[k], (t, v))
        else:
            if k in open_:
                out.append((k, *open_[k]))
            open_[k] = (t, v)
    return sorted(out + [(k, *x) for k, x in open_.items()])


def test_debounce_with_late_rows_and_a_restart(spark, feed):
    r = random.Random(1)
    rows = [(r.choice("abc"), at(r.randrange(4000) / 2), float(k)) for k in range(300)]
    f = feed("k string, t timestamp, v double")
    make = lambda s: timers.debounced(s, "k", "t", "v", 20_000, delay="60 seconds")
    some = parts(rows, 60, 6)
    for p in some[:3]:
        f.put(p)
    half = f.run(make)
    for p in some[3:] + [[("z", at(FAR), 0.0)], [("z", at(FAR + 1), 0.0)]]:
        f.put(p)
    got = f.run(make)
    assert 0 < len(half) < len(got) and set(half) <= set(got)
    assert got == bursts(rows, 20)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != timers.PROVIDER


def test_newer_requests_cancel(feed):
    r = random.Random(2)
    rows = [(r.choice("ab"), at(k * 5 + r.randrange(4)), k, r.choice([1000, 8000, 30000])) for k in range(120)]
    f = feed("k string, t timestamp, id long, took long")
    make = lambda s: timers.answered(s, "k", "t", "id", "took", delay="40 seconds")
    for p in parts(rows, 40, 5)[:2]:
        f.put(p)
    f.run(make)
    for p in parts(rows, 40, 5)[2:] + [[("z", at(FAR), -1, 1)], [("z", at(FAR + 1), -2, 1)]]:
        f.put(p)
    want, by = [], {}
    for k, t, i, n in sorted(rows):
        by.setdefault(k, []).append((t, i, n))
    for k, x in by.items():
        for (t, i, n), after in zip(x, [*x[1:], None]):
            end = t + dt.timedelta(milliseconds=n)
            want.append((k, i, "cancelled", after[0]) if after and after[0] < end else (k, i, "done", end))
    assert [g for g in f.run(make) if g[1] >= 0] == sorted(want)


def test_records_expire_unless_cancelled(feed):
    rows = [("a", at(0), -1, False), ("b", at(0), 0, False), ("c", at(0), 3000, False), ("c", at(1), None, True), ("d", at(0), 2000, False), ("d", at(4), None, True), ("e", at(2), None, False), ("e", at(1), None, True), ("f", at(1), 500, False), ("f", at(3), 500, False), ("g", at(5), None, True)]
    f = feed("k string, t timestamp, ms int, cancel boolean")
    for p in ([rows[3], *rows[:3]], rows[4:7], rows[7:], [("z", at(FAR), 0, False)], [("z", at(FAR + 1), 0, False)]):
        f.put(p)
    got = f.run(lambda s: timers.expiring(s, "k", "t", "ms", delay="100 seconds"))
    assert got == [("a", at(0), at(5)), ("d", at(0), at(2)), ("e", at(2), at(7)), ("f", at(1), at(1.5)), ("f", at(3), at(3.5))]


def test_no_rows(spark, feed):
    f = feed("k string, t timestamp, v double")
    f.put([])
    with timers.using(spark):
        s = spark.readStream.schema(f.schema).parquet(str(f.folder / "in")).withColumn("x", F.lit(1))
        assert drained(timers.debounced(s, "k", "t", "v", 1000)).count() == 0


class Handle:
    """What a processor asks of Spark, held in lists."""

    def __init__(self):
        self.timers, self.list = [], []

    def getListState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def exists(self):
        return bool(self.list)

    def get(self):
        return iter(self.list)

    def put(self, items):
        self.list = list(items)

    def clear(self):
        self.list = []


def test_one_timer_stands_for_all_moments_of_a_bucket():
    import pandas as pd

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815

    n, second = 500, 1_000_000
    p, handle = timers._Records(), Handle()
    p.names, p.inputs = ["key_row", "shown_micros", "hidden_micros"], ["key_row", "at_row", "ms_row", "stop_row"]
    p.init(handle)
    rows = pd.DataFrame({"key_row": [str(k % 100) for k in range(n)], "at_row": [k * second for k in range(n)], "ms_row": [1000] * n, "stop_row": [False] * n})
    list(p.handleInputRows((0,), iter([rows]), Now(0)))
    assert handle.timers == [1000] and len(handle.list) == n
    # one call settles everything up to the watermark, and the next timer is that of the first record left
    out = pd.concat(p.handleExpiredTimer((0,), Now(300_000), Now(1000)))
    assert len(out) == 300 and handle.timers == [1000, 301_000] and len(handle.list) == n - 300
    out = pd.concat(p.handleExpiredTimer((0,), Now(10_000_000), Now(301_000)))
    assert len(out) == n - 300 and handle.timers == [1000, 301_000] and not handle.list
