"""Binary barrels as a Spark data source: `.barrel` and `.barrel.gz` files, read and written document by document.

A file is a big-endian 32-bit number of documents, then of each its index, its length and as
many word hashes. Reading takes a task a file and holds one document at a time. Writing takes
a file a task: documents go to a file without their number, which becomes known at its end and is then put before them;
files appear in the folder when all tasks are done, and a task that is lost or repeated leaves nothing there.
"""

from __future__ import annotations

import gzip
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "idx int, hashes array<int>"


def filesystem(path: str):
    """(file system, path in it) of a path or URI, with pyarrow's file systems."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def documents(stream: BinaryIO) -> Iterator[tuple[int, list[int]]]:
    """(index, hashes) of a barrel's documents; a stream that ends early is an error."""

    def read(n: int) -> bytes:
        raw = stream.read(n)
        if len(raw) != n:
            raise ValueError("a barrel ends before its last document")
        return raw

    (n,) = struct.unpack(">i", read(4))
    for _ in range(n):
        idx, length = struct.unpack(">ii", read(8))
        yield idx, list(struct.unpack(f">{length}i", read(4 * length)))


def record(idx: int, hashes: list[int]) -> bytes:
    return struct.pack(f">ii{len(hashes)}i", idx, len(hashes), *hashes)


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    documents: int


class BarrelReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
        names = sorted(f.path for f in found if f.is_file and f.base_name.endswith((".barrel", ".barrel.gz")))
        return [File(n) for n in names]

    def read(self, partition: File) -> Iterator[tuple[int, list[int]]]:
        system, _ = filesystem(self.path)
        with system.open_input_stream(partition.path, compression=None) as raw:
            # Pipes of bytes, not of whole files: gzip unpacks as it is read.
            yield from documents(gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw)


class BarrelWriter(DataSourceWriter):
    def __init__(self, path: str, compressed: bool, overwrite: bool) -> None:
        self.path, self.compressed, self.overwrite, self.run = path, compressed, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, folder = filesystem(self.path)
        name = f"{folder}/_temporary-{self.run}/{uuid.uuid4().hex}"  # of this attempt alone
        system.create_dir(f"{folder}/_temporary-{self.run}", recursive=True)
        n, body = 0, f"{name}.body"
        with system.open_output_stream(body, compression=None) as out:
            for row in rows:
                out.write(record(row[0], row[1]))
                n += 1
        if not n:
            system.delete_file(body)
            return Written(None, 0)
        done = f"{name}.barrel.gz" if self.compressed else f"{name}.barrel"
        with system.open_input_stream(body, compression=None) as source, system.open_output_stream(done, compression=None) as out:
            sink = gzip.GzipFile(fileobj=out, mode="wb") if self.compressed else out
            sink.write(struct.pack(">i", n))
            shutil.copyfileobj(source, sink, 1 << 20)
            if self.compressed:
                sink.close()
        system.delete_file(body)
        return Written(done, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.is_file and f.base_name.endswith((".barrel", ".barrel.gz")):
                    system.delete_file(f.path)
        for k, m in enumerate(m for m in messages if m and m.path):
            system.move(m.path, f"{folder}/part-{k:05d}-{self.run[:8]}{'.barrel.gz' if self.compressed else '.barrel'}")
        self.abort([])

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, folder = filesystem(self.path)
        left = f"{folder}/_temporary-{self.run}"
        if system.get_file_info(left).type != fs.FileType.NotFound:
            system.delete_dir(left)


class BarrelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "barrel"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BarrelReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BarrelWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(idx, hashes) of a barrel file, or of all in a folder."""
    spark.dataSource.register(BarrelSource)
    return spark.read.format("barrel").load(path)


def write(hashed: DataFrame, path: str, compression: str = "gzip") -> None:
    """(idx int, hashes array<int>) as binary barrels in a folder, replacing those that are there."""
    hashed.sparkSession.dataSource.register(BarrelSource)
    hashed.selectExpr("cast(idx as int) as idx", "hashes").write.format("barrel").mode("overwrite").option("compression", compression).save(path)
