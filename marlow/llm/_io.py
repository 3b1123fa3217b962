"""Reading tables, and tables written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "512"
_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in small Arrow batches, so that a batch of the longest documents fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="marlow-")
            atexit.register(shutil.rmtree, base, True)
        _folders[app] = f"{base.rstrip('/')}/marlow-{app}"
    return _folders[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, dealt into buckets by `key`, so that joins by it, one after the other, don't shuffle df again."""
    spark = df.sparkSession
    called = f"marlow_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_folder(spark)}/{called}").saveAsTable(called)
    out = spark.table(called)
    spark.sql(f"DROP TABLE {called}")  # the files stay, as with written()
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that written() made and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast only what was counted and is within the limit; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df
