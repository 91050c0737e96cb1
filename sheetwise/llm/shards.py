"""Sharding by size-tiered compaction, with a versioned manifest that is committed atomically."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh

#: Bytes of a finished shard, runs of one tier that trigger a merge, and the ratio between tiers.
TARGET, FANOUT, RATIO = 256 << 20, 4, 4
#: Rows of an arriving shard at most.
ARRIVAL_ROWS = 20_000
#: Versions that expire() keeps, and the age from which an empty version's writer counts as lost.
KEEP, STALE_S = 2, 600


@dataclass(frozen=True)
class Shard:
    """An immutable file: its path below the store, its bytes and the version that added it."""

    path: str
    bytes: int
    added: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Immutable Parquet shards below a folder, and manifests/NNNNNNNN.json, each naming the full list of one version.

    Files are written first and become visible only by the manifest. A commit writes the list under a name of its own, then
    creates the version's file, which holds that name; creating a file that exists is refused, so of two writers one wins and
    the other's files stay invisible. Stores such as HDFS refuse atomically; for local paths, where Hadoop looks first and
    creates then, Java's own atomic call is used. A version whose writer was lost between the two steps is empty: readers pass it over, and
    so do writers after STALE_S seconds. A lost executor leaves no trace: Spark's committer moves files only of tasks that ended.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    # ---- manifests ----

    def _claimed(self) -> dict[int, tuple[int, int]]:
        """Bytes and time of each version's file."""
        files = [f for f in self._fs.listStatus(self._path(f"{self.path}/manifests")) if f.getPath().getName()[0].isdigit()]
        return {int(f.getPath().getName().removesuffix(".json")): (f.getLen(), f.getModificationTime()) for f in files}

    def versions(self) -> list[int]:
        return sorted(v for v, (size, _) in self._claimed().items() if size)

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{name}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, by default the latest; none before the first."""
        known = self.versions()
        if not known:
            return []
        at = known[-1] if version is None else version
        return [Shard(**s) for s in json.loads(self._text(self._text(f"{at:08d}.json")))["shards"]]

    def _put(self, name: str, text: str, exclusive: bool = False) -> None:
        at = self._path(f"{self.path}/manifests/{name}")
        if exclusive:
            if self._fs.getScheme() == "file" and not self.spark._jvm.java.io.File(at.toUri().getPath()).createNewFile():
                raise Conflict(f"{name} exists")
            try:
                stream = self._fs.create(at, self._fs.getScheme() == "file")
            except Py4JJavaError as e:
                if "AlreadyExists" in str(e.java_exception):
                    raise Conflict(f"{name} exists") from None
                raise
        else:
            stream = self._fs.create(at, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def commit(self, shards: list[Shard], base: int) -> int:
        """Publishes the version after base, or raises Conflict if another writer has."""
        body = f"_{uuid.uuid4().hex}.json"
        self._put(body, json.dumps({"shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]}))
        claimed, now = self._claimed(), time.time() * 1000
        version = base + 1
        while version in claimed and not claimed[version][0] and now - claimed[version][1] > STALE_S * 1000:
            version += 1
        try:
            self._put(f"{version:08d}.json", body, exclusive=True)
        except Conflict:
            self._fs.delete(self._path(f"{self.path}/manifests/{body}"), False)
            raise
        return version

    # ---- data ----

    def _write(self, df: DataFrame, version: int, rows: int = 0) -> list[Shard]:
        folder = f"runs/{version:08d}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(f"{self.path}/{folder}")
        files = {f.getPath().getName(): f.getLen() for f in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if f.getPath().getName().startswith("part-")}
        name = F.col("_metadata.file_name")
        full = {r["name"] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy(name.alias("name")).count().collect()} if files else set()  # a row for each file, from the footers
        for empty in files.keys() - full:
            self._fs.delete(self._path(f"{self.path}/{folder}/{empty}"), False)
        return [Shard(f"{folder}/{f}", files[f], version) for f in sorted(full)]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Adds the rows as small shards, a few for each input partition, without a shuffle."""
        base = (self.versions() or [0])[-1]
        return self.commit(self.shards() + self._write(df, base + 1, rows), base)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, or None if it has no shard."""
        paths = [f"{self.path}/{s.path}" for s in self.shards(version)]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    # ---- compaction ----

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> int | None:
        """One round: in each tier with enough runs, merges them to files of about the target; the new version, or None.

        A merge reads the runs of one tier only and is a job without a shuffle: the reader packs small files into
        partitions of the target size, and each writes one file. Its settings are those of a session of its own. A merge is kept only if it
        leaves fewer files. Columns that only some runs have are null in the others' rows.
        """
        base = (self.versions() or [0])[-1]
        now = self.shards()
        reader = self.spark.newSession()
        for k, v in {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
            reader.conf.set(k, v)
        merged, gone = [], set()
        for own in merge_groups(now, target, fanout):
            made = self._write(reader.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{s.path}" for s in own)), base + 1)
            if len(made) < len(own):
                merged += made
                gone |= {s.path for s in own}
            else:
                self._fs.delete(self._path(f"{self.path}/{made[0].path}").getParent(), True)
        return self.commit([s for s in now if s.path not in gone] + merged, base) if gone else None

    def expire(self, keep: int = KEEP) -> None:
        """Deletes manifests older than the last few, and shards that no kept version lists. A reader of a kept version is not disturbed."""
        known = self.versions()
        live = {s.path for v in known[-keep:] for s in self.shards(v)}
        dead = {s.path for v in known[:-keep] for s in self.shards(v)} - live
        for v in known[:-keep]:
            body = self._text(f"{v:08d}.json")
            for name in (f"{v:08d}.json", body):
                self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)
        for p in sorted(dead):
            self._fs.delete(self._path(f"{self.path}/{p}"), False)


def tier(size: int, target: int, ratio: int = RATIO) -> int:
    """0 for files near the target, then one more for each ratio below it."""
    return 0 if size * ratio > target * (ratio - 1) else 1 + max(0, math.floor(math.log(target / max(1, size), ratio)))


def merge_groups(shards: list[Shard], target: int, fanout: int = FANOUT) -> list[list[Shard]]:
    """The runs to merge now, by tier: those of every tier but the finished one that has `fanout` of them, or a target's worth."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: s.path):
        if t := tier(s.bytes, target):
            tiers.setdefault(t, []).append(s)
    return [own for _, own in sorted(tiers.items()) if len(own) >= fanout or len(own) > 1 and sum(s.bytes for s in own) >= target]


def arrivals(docs: DataFrame, key: str, n: int) -> list[DataFrame]:
    """docs in n parts by ranges of a key, about equally many keys each; rows without a key come first, and a part may be empty."""
    ends = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    ends = sorted(set(ends or []))  # n - 1 numbers
    k = F.col(key)
    if not ends:
        return [docs]
    return [docs.where(k.isNull() | (k <= ends[0])), *(docs.where((k > a) & (k <= b)) for a, b in zip(ends, ends[1:])), docs.where(k > ends[-1])]


def shard(docs: DataFrame | list[DataFrame], path: str, target: int = TARGET, rows: int = ARRIVAL_ROWS, fanout: int = FANOUT) -> tuple[ShardStore, DataFrame]:
    """Appends all rows, or several arrivals one by one, compacts after each until nothing is left to merge, and returns the store and its rows.
    The last KEEP versions stay.

    The rows are those of docs, nulls, repeats and extra columns included, with `_shard`, the number of the shard in the final manifest,
    `_shard_bytes` and `_version`; columns of docs with these names are replaced. An empty table commits an empty version.
    """
    parts = [d.drop("_shard", "_shard_bytes", "_version") for d in (docs if isinstance(docs, list) else [docs])]
    docs, spark = parts[0], parts[0].sparkSession
    store = ShardStore(spark, path)
    for part in parts:
        store.append(part, rows)
        while store.compact(target, fanout) is not None:
            store.expire()
    files = store.shards()
    version = store.versions()[-1]
    if not files:
        out = docs.limit(0).withColumns({"_shard": F.lit(0), "_shard_bytes": F.lit(0).cast("long"), "_version": F.lit(version)})
        return store, out
    # a row for each file, as a table of known size: the planner sends it whole only below its own bound
    rows_in = store.read()
    at, name = fresh("_path", docs), fresh("_file", docs)
    listed = cut(spark.createDataFrame([(s.path, i, s.bytes) for i, s in enumerate(files)], f"`{at}` string, _shard int, _shard_bytes long"))
    rows_in = rows_in.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"(runs/[^/]+/[^/]+)$", 1))
    return store, rows_in.join(listed, F.col(name) == F.col(at)).drop(name, at).withColumn("_version", F.lit(version))
