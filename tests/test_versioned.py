"""Writes that commit or leave what was there, batches that are written once, documents rewritten in place."""

import os

import pytest
from pyspark.sql import functions as F

from marlow.sources import versioned


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def staged(path):
    return sorted(f for _, _, files in os.walk(f"{path}/data") for f in files if f.endswith(".parquet"))


def test_versions_and_unchanged_rows(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(10).select("id", F.concat(F.lit("v"), "id").alias("s"))
    with pytest.raises(Exception, match="nothing is committed"):
        versioned.read_version(spark, path).collect()
    assert versioned.write_version(df, path) and not versioned.write_version(df.repartition(3), path)
    assert versioned.write_version(df.where("id < 3"), path) and versioned.Table(path).versions() == [1, 2]
    assert rows(versioned.read_version(spark, path)) == rows(df.where("id < 3")) and rows(versioned.read_version(spark, path, 1)) == rows(df)
    df.where("id = 7").write.format("versioned").mode("append").save(path)
    assert rows(versioned.read_version(spark, path)) == rows(df.where("id < 3 or id = 7"))
    assert versioned.write_version(df.limit(0), path) and versioned.read_version(spark, path).count() == 0


def test_a_failed_task_leaves_the_old_version(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(40, numPartitions=4).toDF("id")
    versioned.write_version(df, path)
    files = staged(path)
    broken = df.select(F.when(F.col("id") == 35, F.raise_error("broken row").cast("long")).otherwise(F.col("id") + 100).alias("id"))
    with pytest.raises(Exception, match="broken row|SparkException|failed"):
        broken.write.format("versioned").mode("overwrite").save(path)
    assert rows(versioned.read_version(spark, path)) == rows(df)
    versioned.Table(path).vacuum()
    assert staged(path) == files and versioned.Table(path).versions() == [1] and rows(versioned.read_version(spark, path)) == rows(df)


def test_a_batch_is_committed_once(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    spark.range(20).write.parquet(source)
    spark.dataSource.register(versioned.Versioned)

    def run(state):
        s = spark.readStream.schema("id long").parquet(source)
        q = s.writeStream.format("versioned").option("path", path).option("query", "q").option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
        q.awaitTermination()

    run("state")
    run("state")
    assert versioned.read_version(spark, path).count() == 20
    # a checkpoint that was lost: the same batch comes again
    run("state2")
    assert versioned.read_version(spark, path).count() == 20 and len(staged(path)) == len(versioned.Table(path).manifest()["files"])


def test_documents_rewritten_in_place(spark, tmp_path):
    doc, other = tmp_path / "docs" / "a.json", tmp_path / "docs" / "b.json"
    doc.parent.mkdir()

    def run():
        q = versioned.watched(spark, str(doc.parent)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((os.path.basename(r.path), r.content) for r in spark.read.schema("path string, digest string, content string").parquet(str(tmp_path / "out")).collect())

    doc.write_text("one")
    assert run() == [("a.json", "one")]
    doc.write_text("two")
    other.write_text("beside")
    assert run() == [("a.json", "one"), ("a.json", "two"), ("b.json", "beside")]
    assert run() == [("a.json", "one"), ("a.json", "two"), ("b.json", "beside")]
    os.utime(doc)  # touched, not changed
    assert len(run()) == 3
    doc.write_text("six")  # the same length
    other.unlink()
    assert run() == [("a.json", "one"), ("a.json", "six"), ("a.json", "two"), ("b.json", "beside")]


def test_one_stream_sees_every_rewrite(spark, tmp_path):
    doc = tmp_path / "d.json"
    doc.write_text("1")
    seen = []
    q = versioned.watched(spark, str(doc)).writeStream.foreachBatch(lambda b, n: seen.extend(r.content for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        for text in ("2", "3"):
            doc.write_text(text)
            q.processAllAvailable()
    finally:
        q.stop()
    assert seen == ["1", "2", "3"]
