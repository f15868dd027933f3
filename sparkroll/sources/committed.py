"""A sink that stores each iteration once, as a Spark data source with a commit step.

Tasks write files under names nobody else uses and report them; the driver then
names the files of each iteration in one manifest, put in place by a rename.
Readers see files of manifests only, so failed, repeated and speculative tasks
leave nothing that counts, and an aborted write removes what it wrote. Where
two writers commit the same iteration, the first one stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "committed"
KINDS = ("parquet", "jsonl")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(path)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _manifests(path: str) -> dict[int, list[str]]:
    """Committed iterations and their files, relative to the path."""
    files, root = _filesystem(path)
    found = {}
    for entry in files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
        if entry.base_name.endswith(".json"):
            with files.open_input_stream(entry.path) as stream:
                found[int(entry.base_name[:-5])] = json.loads(stream.read())["files"]
    return found


class _JsonLines:
    def __init__(self, stream):
        self.stream = stream

    def write_batch(self, batch: pa.RecordBatch) -> None:
        self.stream.write("".join(json.dumps(row, ensure_ascii=False, default=str) + "\n" for row in batch.to_pylist()).encode())

    def close(self) -> None:
        self.stream.close()


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (iteration, file) pairs."""

    files: list[tuple[int, str]]


class CommittedSink(DataSource):
    """`df.write.format("committed").option("key", "iteration").option("kind", "parquet" or "jsonl").mode("append").save(path)`"""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> CommittedWriter:
        if overwrite:
            raise ValueError("a committed iteration is never overwritten: use mode append")
        return CommittedWriter(self.options["path"], self.options.get("key", "iteration"), self.options.get("kind", "parquet"))


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, kind: str):
        if kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}, not {kind}")
        self.path, self.key, self.kind = path, key, kind
        self.write_id = uuid.uuid4().hex

    def _open(self, files: fs.FileSystem, name: str, schema: pa.Schema):
        if self.kind == "parquet":
            return pq.ParquetWriter(name, schema, filesystem=files)
        return _JsonLines(files.open_output_stream(name, compression="gzip"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _filesystem(self.path)
        folder = f"writes/{self.write_id}"
        files.create_dir(f"{root}/{folder}", recursive=True)
        written: list[tuple[int, str]] = []
        out = None
        try:
            for batch in iterator:
                keys = batch.column(batch.schema.get_field_index(self.key))
                for value in pc.unique(keys).to_pylist():
                    if value is None:
                        raise ValueError(f"{self.key} is null: such rows belong to no iteration")
                    if out is None or written[-1][0] != value:
                        if out is not None:
                            out.close()
                        written.append((value, f"{folder}/{value}-{uuid.uuid4().hex}.{'parquet' if self.kind == 'parquet' else 'jsonl.gz'}"))
                        out = self._open(files, f"{root}/{written[-1][1]}", batch.schema)
                    out.write_batch(batch.filter(pc.equal(keys, value)))
            if out is not None:
                out.close()
        except BaseException:
            for _, name in written:
                if files.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    files.delete_file(f"{root}/{name}")
            raise
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _filesystem(self.path)
        files.create_dir(f"{root}/manifests", recursive=True)
        named: dict[int, list[str]] = {}
        for message in messages:
            for value, name in message.files if message else []:
                named.setdefault(value, []).append(name)
        for value, names in named.items():
            place = f"{root}/manifests/{value}.json"
            if files.get_file_info(place).type != fs.FileType.NotFound:
                for name in names:
                    files.delete_file(f"{root}/{name}")
                continue
            with files.open_output_stream(f"{place}.{self.write_id}") as stream:
                stream.write(json.dumps({"files": names}).encode())
            files.move(f"{place}.{self.write_id}", place)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _filesystem(self.path)
        folder = f"{root}/writes/{self.write_id}"
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


def read_committed(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The rows of all committed iterations, by Spark's own readers."""
    names = [f"{path}/{name}" for found in _manifests(path).values() for name in found]
    if not names:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.parquet(*names) if kind == "parquet" else reader.json(names)


def write_missing(df: DataFrame, path: str, key: str = "iteration", kind: str = "parquet") -> DataFrame:
    """Store the iterations that are not committed yet, in one job; all stored rows, with `reused` for the earlier ones."""
    spark = df.sparkSession
    spark.dataSource.register(CommittedSink)
    done = sorted(_manifests(path))
    fresh = df.where(~F.col(key).isin(done)) if done else df
    # sorted, a task has one file open at a time
    fresh.sortWithinPartitions(key).write.format(NAME).option("key", key).option("kind", kind).mode("append").save(path)
    return read_committed(spark, path, df.schema, kind).withColumn("reused", F.col(key).isin(done) if done else F.lit(False))
