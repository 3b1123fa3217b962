"""Files on disk, sinks, and streams against their batch forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlow.operators import images
from marlow.plans.source_queries import drained
from marlow.sources import files
from marlow.streaming import stateful


def test_json_documents(spark, tmp_path):
    schema = T.StructType([T.StructField("content", T.StringType()), T.StructField("done", T.BooleanType())])
    p = tmp_path / "todo.json"
    assert files.json_records(spark, str(p), schema).count() == 0
    p.write_text(json.dumps([{"content": "a", "done": True}, {"content": "b"}]))
    assert [tuple(r) for r in files.json_records(spark, str(p), schema).collect()] == [("a", True), ("b", None)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a\nb\n\nc")
    assert [r.value for r in files.records_by_marker(spark, str(tmp_path / "r.txt")).collect()] == ["a\nb", "c"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.QML").write_text("tr(1)")
    assert files.whole_texts(spark, str(tmp_path), "*.QML").count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path), "{*.qml,*.jpg}").collect()] == ["x.QML"]
    (tmp_path / "main.conf").write_text("set a\nsource-file sub/more.conf\n")
    (tmp_path / "sub/more.conf").write_text("set b\n")
    assert sorted(r.value for r in files.with_sourced(spark, str(tmp_path / "main.conf"), str(tmp_path)).collect()) == ["set a", "set b", "source-file sub/more.conf"]


def test_sourced_files_at_any_depth(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k}.conf").write_text(f"set {k}\nsource-file {(k + 1) % 20}.conf\n")
    got = [r.value for r in files.with_sourced(spark, str(tmp_path / "0.conf"), str(tmp_path)).collect()]
    assert sorted(v for v in got if v.startswith("set")) == sorted(f"set {k}" for k in range(20))


def test_images_from_files(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 3 2 255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.pgm").write_bytes(b"junk")
    rows = images.greys(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("img").collect()
    assert [(r.height, r.width, r.pixels) for r in rows] == [(2, 3, [1, 2, 3, 4, 5, 6]), (None, None, None)]


def test_staged_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}]')
    spark.dataSource.register(files.Staged)
    rows = spark.read.format("staged").option("urls", f"file://{tmp_path}/a.json file://{tmp_path}/none.json nonsense").load().orderBy("url").collect()
    assert [(r.status, r.body if r.status > 0 else "") for r in rows] == [(200, '[{"id": 1}]'), (-1, ""), (-1, "")]


def test_archives(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("pane-0")
        info.size = 5
        tar.addfile(info, io.BytesIO(b"hello"))
    (tmp_path / "x.tar.gz").write_bytes(b"junk")
    got = files.archived(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.name, r.text) for r in got] == [("pane-0", "hello")]


def test_sinks(spark, tmp_path):
    df, out, old = spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "out"), str(tmp_path / "old")
    assert files.write_if_changed(df, out, old) and not files.write_if_changed(df, out, old)
    assert files.write_if_changed(df.withColumn("v", F.lit("b")), out, old) and spark.read.parquet(old).first().v == "a" and spark.read.parquet(out).first().v == "b"
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == "a"
    stale, sign = files.is_stale(df, ["k", "v"], None)
    assert stale and files.is_stale(df, ["k", "v"], sign) == (False, sign)


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def feed(spark, tmp_path):
    """A stream that reads one small file at a time, in order."""
    import os
    import time

    def make(parts, schema):
        folder = tmp_path / "feed"
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
            folder.mkdir(exist_ok=True)
            part = next((tmp_path / f"p{i}").glob("part-*.parquet"))
            os.rename(part, folder / f"{i}.parquet")
            os.utime(folder / f"{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def test_limiter_keeps_state_between_batches(spark, feed):
    s = feed([[("a", at(0), 10.0), ("a", at(1), 90.0)], [("a", at(2), 15.0), ("b", at(2), 99.0), ("a", at(3), 26.0)]], "k string, t timestamp, v double")
    got = {(r.k, r.t.second): r.accepted for r in drained(stateful.limited(s, "k", "t", "v", 10.0, 80.0)).collect()}
    assert got == {("a", 0): 10.0, ("a", 1): 10.0, ("a", 2): 15.0, ("a", 3): 15.0, ("b", 2): 99.0}
    assert stateful.limit_step(85.0, 79.0, 10.0, 80.0) == 79.0 and stateful.limit_step(95.0, 90.0, 10.0, 80.0) == 80.0


def test_usage_and_deltas(spark, feed):
    s = feed([[("a", at(0), 4.0, 10.0)], [("a", at(1), 6.0, 20.0), ("a", at(2), 6.0, 20.0)]], "k string, t timestamp, i double, n double")
    assert sorted((r.t.second, r.usage) for r in drained(stateful.usage_stream(s, "k", "t", "i", "n")).collect()) == [(0, None), (1, pytest.approx(0.8)), (2, 0.0)]


def test_framing_across_batches(spark, feed):
    s = feed([[("m", 0, "["), ("m", 1, '{"a":')], [("m", 2, "1}"), ("m", 3, ","), ("m", 4, '{"a":2}'), ("m", 5, "]")]], "k string, seq int, line string")
    assert sorted(r.json for r in drained(stateful.framed_stream(s, "k", "seq", "line")).collect()) == ['{"a":\n1}', '{"a":2}']


def test_expiry(spark, feed):
    rows = [[("a", at(0), -1, False), ("b", at(0), 0, False), ("c", at(0), 3000, False)], [("c", at(1), None, True)], [("z", at(60), 0, False)], [("z", at(61), 0, False)]]
    s = feed(rows, "k string, t timestamp, ms int, cancel boolean")
    streamed = sorted((r.k, r.shown, r.hidden) for r in drained(stateful.expiring(s, "k", "t", "ms")).collect())
    flat = spark.createDataFrame([r for part in rows for r in part], "k string, t timestamp, ms int, cancel boolean")
    assert streamed == sorted((r.k, r.shown, r.hidden) for r in stateful.expiring(flat, "k", "t", "ms").collect()) == [("a", at(0), at(5))]


def test_json_stream_and_refresh(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"a": 1}')
    seen = []
    q = stateful.refresh_on_event(files.json_files_stream(spark, str(tmp_path / "in"), schema), lambda b, n: seen.extend(r.a for r in b.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == [1] and stateful.polled(spark).isStreaming
