"""Digests of files of any size: a data source that lists files on the driver and hashes them in chunks on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .artifacts import PNG_LEAST, PNG_SIGNATURE

#: Bytes read at a time, and of files together in one partition: many small ones share it, a large one has its own.
CHUNK, SHARE = 4 << 20, 256 << 20
#: Files of one partition at most.
MANY = 4096


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]) -> None:
        self.names = names


class DigestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.share = int(options.get("share", SHARE))

    def partitions(self) -> Sequence[InputPartition]:
        """Files below the path in the order of their names, packed by size."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        packs: list[list[tuple[str, int]]] = []
        room = 0
        for name, size in found:
            if not packs or size > room or len(packs[-1]) >= MANY:
                packs.append([])
                room = self.share
            packs[-1].append((name, size))
            room -= size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for at in range(0, len(partition.names), 1024):
            rows = []
            for name, _size in partition.names[at : at + 1024]:
                digest, length, head = hashlib.sha256(), 0, b""
                with store.open_input_stream(name) as stream:
                    while chunk := stream.read(CHUNK):
                        head = head or chunk[: len(PNG_SIGNATURE)]
                        digest.update(chunk)
                        length += len(chunk)
                rows.append((name, length, digest.hexdigest(), head == PNG_SIGNATURE and length > PNG_LEAST))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.bool_()))], ["path", "length", "sha256", "is_png"])


class Digests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "digests"

    def schema(self) -> str:
        return "path string, length long, sha256 string, is_png boolean"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(self.options)


def digests(spark: SparkSession, uri: str, share: int = SHARE) -> DataFrame:
    """(path, length, sha256, is_png) of all files below a folder, as files() gives them, but for files of any size.

    uri names a store that pyarrow opens (file, hdfs, s3, gs). A file is never in memory as a whole, and no list of files but their names and
    sizes is on the driver. files() reads whatever store Spark does, up to 2 GB a file, and passes over empty ones.
    """
    spark.dataSource.register(Digests)
    return spark.read.format("digests").option("share", share).load(uri)
