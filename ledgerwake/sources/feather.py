"""Feather (Arrow IPC) files as a source and a sink.

A file is read by its record batches, each of them a partition, and of each batch only the columns that are asked for. Paths are
opened by pyarrow's file systems, on the driver for the footers and on the executors for the batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from .written import own_folder

FORMAT = "ledgerwake_feather"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The files of a folder, or the file, in order of their names."""
    system, own = _located(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.Directory:
        found = [x.path for x in system.get_file_info(fs.FileSelector(own)) if x.is_file and not x.base_name.startswith(("_", "."))]
    else:
        found = [own]
    if not found or info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no Feather file at {path}")
    head = path.removesuffix(own) if "://" in path else ""
    return [f"{head}{x}" for x in sorted(found)]


def _opened(path: str, columns: list[str] | None = None) -> pa.ipc.RecordBatchFileReader:
    system, own = _located(path)
    source = system.open_input_file(own)
    if columns is None:
        return pa.ipc.open_file(source)
    names = pa.ipc.open_file(source).schema.names
    source.seek(0)
    return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns]))


class Batch(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns, self.schema = path, schema.names, schema

    def partitions(self) -> list[Batch]:
        return [Batch(path, k) for path in _files(self.path) for k in range(_opened(path).num_record_batches)] or [Batch(_files(self.path)[0], -1)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if partition.number >= 0:
            own = _opened(partition.path, self.columns).get_batch(partition.number)
            kinds = to_arrow_schema(self.schema)  # nanoseconds, dictionaries and the like become what Spark has for them
            yield pa.RecordBatch.from_arrays([own[c].cast(kinds.field(c).type, safe=False) for c in self.columns], self.columns)


class FeatherSource(DataSource):
    """Options: path, and columns, comma-joined; all columns if there is none."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        found = _opened(_files(self.options["path"])[0]).schema
        wanted = [c for c in (self.options.get("columns") or "").split(",") if c] or found.names
        if lacking := [c for c in wanted if c not in found.names]:
            raise ValueError(f"no column {lacking[0]!r} in {self.options['path']}; there are {found.names}")
        return from_arrow_schema(pa.schema([found.field(c) for c in wanted]), prefer_timestamp_ntz=True)

    def reader(self, schema) -> FeatherReader:
        return FeatherReader(self.options["path"], schema)


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a Feather file or of a folder of them; of a wide frame too, whose index is a column."""
    spark.dataSource.register(FeatherSource)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def write_feather(df: DataFrame, path: str | None = None) -> str:
    """Writes a file for each partition, a record batch for each batch that Spark hands on, into a folder (by default one in the shared folder), whose path is returned. A task that is run again writes its file anew."""
    path = path or f"{own_folder(df.sparkSession)}/feather-{uuid.uuid4().hex}"
    system, own = _located(path)
    system.create_dir(own, recursive=True)
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = _located(path)
        name, sink, target = "", None, None
        for batch in batches:
            rows = batch.select(names)
            if sink is None:
                # hidden from readers until it is whole; a task's second run replaces what its first one left
                name = f"part-{batch['_part'][0].as_py():05d}.feather"
                target = system.open_output_stream(hidden := f"{own}/_{name}-{uuid.uuid4().hex}")
                sink = pa.ipc.new_file(target, rows.schema)
            sink.write_batch(rows)
        if sink is not None:
            sink.close()
            target.close()
            system.move(hidden, f"{own}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name] if name else [], pa.string())], ["name"])

    if not df.withColumn("_part", F.spark_partition_id()).mapInArrow(write, "name string").count():
        with system.open_output_stream(f"{own}/part-00000.feather") as target, pa.ipc.new_file(target, df.limit(0).toArrow().schema):
            pass
    return path
