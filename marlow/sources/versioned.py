"""Python data sources whose writes commit, and documents that are watched where they lie.

`versioned`: a table as numbered versions. Tasks stage Parquet files; when all are done, the driver writes one manifest that
lists the files of the new version, and moves it into place, which is the commit. A task that fails, or a job that aborts,
leaves the last version as it was; its folder is removed, and what tasks that were still running put there is for vacuum(). As a stream's sink a batch is committed once: a batch that comes
again after a restart is known by its number. Older versions stay readable. One writer at a time.

`watched`: a stream of documents that are rewritten in place. The offset is each document's version (time, length, digest), so
a version is read once, also after a restart; a document is read again only if its time or length has changed. A version that
was overwritten before it was read is gone: the batch has no row for it, and the newer version comes in the next one. The
documents are configuration, few and small: a partition reads one whole.

Paths are such as pyarrow's file systems open, in a folder that the driver and all executors share.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from marlow.sources.files import is_stale


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


# ---- versions


class Table:
    """The manifests and files below a path."""

    def __init__(self, path: str):
        self.fs, self.root = _open(path.rstrip("/"))

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/_versions", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's files and the stream batches in it; of the last one by default, empty if there is none."""
        at = self.versions() if version is None else [version]
        if not at:
            return {"version": 0, "files": [], "batches": {}, "schema": None, "signature": None}
        with self.fs.open_input_stream(f"{self.root}/_versions/{at[-1]}.json") as f:
            return json.loads(f.read())

    def commit(self, manifest: dict) -> None:
        folder = f"{self.root}/_versions"
        self.fs.create_dir(folder)
        staged = f"{folder}/{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps(manifest).encode())
        self.fs.move(staged, f"{folder}/{manifest['version']}.json")

    def remove(self, files: list[str]) -> None:
        for name in files:
            if self.fs.get_file_info(f"{self.root}/{name}").is_file:
                self.fs.delete_file(f"{self.root}/{name}")

    def remove_job(self, job: str) -> None:
        if self.fs.get_file_info(f"{self.root}/data/{job}").type == fs.FileType.Directory:
            self.fs.delete_dir(f"{self.root}/data/{job}")

    def vacuum(self) -> int:
        """Remove files that no version lists, when no write is running; how many."""
        known = {f for v in self.versions() for f in self.manifest(v)["files"]}
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/data", allow_not_found=True, recursive=True))
        # paths of some file systems come back without their leading slash
        lost = [f.path for f in found if f.is_file and "/".join(["data", *f.path.split("/")[-2:]]) not in known]
        for f in lost:
            self.fs.delete_file(f)
        return len(lost)


@dataclass
class Staged(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"], schema.json(), overwrite
        self.signature, self.query, self.job = options.get("signature"), options.get("query", ""), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        table, name, out = Table(self.path), f"data/{self.job}/{uuid.uuid4().hex}.parquet", None
        try:
            for b in iterator:
                if b.num_rows:
                    if out is None:
                        table.fs.create_dir(f"{table.root}/data/{self.job}")
                        out = pq.ParquetWriter(f"{table.root}/{name}", b.schema, filesystem=table.fs)
                    out.write_batch(b)
        except BaseException:
            # a task that fails tells nobody what it staged
            if out is not None:
                out.close()
                out = None
                table.remove([name])
            raise
        finally:
            if out is not None:
                out.close()
        return Staged(name if out is not None else None)

    def _files(self, messages: list[Staged | None]) -> list[str]:
        return [m.file for m in messages if m is not None and m.file]

    def commit(self, messages: list[Staged | None]) -> None:
        table = Table(self.path)
        old = table.manifest()
        kept = [] if self.overwrite else old["files"]
        table.commit({"version": old["version"] + 1, "files": kept + self._files(messages), "batches": old["batches"], "schema": self.schema, "signature": self.signature})

    def abort(self, messages: list[Staged | None]) -> None:
        Table(self.path).remove_job(self.job)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        table = Table(self.path)
        old = table.manifest()
        if old["batches"].get(self.query, -1) >= batchId:
            table.remove(self._files(messages))
            return
        kept = [] if self.overwrite else old["files"]
        table.commit({"version": old["version"] + 1, "files": kept + self._files(messages), "batches": old["batches"] | {self.query: batchId}, "schema": self.schema, "signature": None})

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        Table(self.path).remove(self._files(messages))


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, version: int | None):
        self.path, self.version = path, version

    def partitions(self) -> list[_File]:
        # a version without rows has one partition that reads nothing
        return [_File(f) for f in Table(self.path).manifest(self.version)["files"]] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            table = Table(self.path)
            with table.fs.open_input_file(f"{table.root}/{partition.name}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class Versioned(DataSource):
    """Options: path; to read, version; to write, signature (kept with the version), query (names a stream)."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def _version(self) -> int | None:
        return int(self.options["version"]) if "version" in self.options else None

    def schema(self) -> StructType:
        known = Table(self.options["path"]).manifest(self._version())["schema"]
        if known is None:
            raise ValueError(f"nothing is committed at {self.options['path']}")
        return StructType.fromJson(json.loads(known))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._version())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(dict(self.options), schema, overwrite)


def write_version(df: DataFrame, path: str) -> bool:
    """df as the next version of a table, unless the rows are those of the last one. Whether it wrote."""
    df.sparkSession.dataSource.register(Versioned)
    stale, signature = is_stale(df, df.columns, Table(path).manifest()["signature"])
    if stale:
        df.write.format("versioned").mode("overwrite").option("signature", signature).save(path)
    return stale


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows; the last one's by default."""
    spark.dataSource.register(Versioned)
    reader = spark.read.format("versioned")
    return (reader if version is None else reader.option("version", version)).load(path)


# ---- watched documents


@dataclass
class _Version(InputPartition):
    path: str
    digest: str


class _Watch(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.known = path, {}

    def _documents(self, disk: fs.FileSystem, root: str) -> list[fs.FileInfo]:
        info = disk.get_file_info(root)
        if info.type == fs.FileType.Directory:
            return sorted((f for f in disk.get_file_info(fs.FileSelector(root)) if f.is_file), key=lambda f: f.path)
        return [info] if info.is_file else []

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        disk, root = _open(self.path)
        now = {}
        for f in self._documents(disk, root):
            old = self.known.get(f.path)
            if old and old[:2] == [f.mtime_ns, f.size]:
                now[f.path] = old
                continue
            with disk.open_input_stream(f.path) as s:
                now[f.path] = [f.mtime_ns, f.size, hashlib.sha256(s.read()).hexdigest()]
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[_Version]:
        return [_Version(p, v[2]) for p, v in end.items() if (start.get(p) or [None] * 3)[2] != v[2]] or [_Version("", "")]

    def read(self, partition: _Version) -> Iterator[tuple[str, str, str]]:
        if not partition.path:
            return
        disk, _ = _open(self.path)
        if not disk.get_file_info(partition.path).is_file:
            return
        with disk.open_input_stream(partition.path) as s:
            data = s.read()
        if hashlib.sha256(data).hexdigest() == partition.digest:
            yield partition.path, partition.digest, data.decode(errors="replace")

    def commit(self, end: dict) -> None:
        pass


class Watched(DataSource):
    """Options: path, a document or a folder of documents. Rows: path, digest, content."""

    @classmethod
    def name(cls) -> str:
        return "watched"

    def schema(self) -> str:
        return "path string, digest string, content string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Watch(self.options["path"])


def watched(spark: SparkSession, path: str) -> DataFrame:
    """A stream of each version of the documents at path."""
    spark.dataSource.register(Watched)
    return spark.readStream.format("watched").option("path", path).load()
