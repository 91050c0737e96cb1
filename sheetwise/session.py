"""Session defaults and table access shared by every query."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Planner settings that hold at any size. Partition counts are left to the deployment and AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionRowLimit": "-1",
}
#: Spark's own bound on the rows of a recursion, which is a matter of size; levels bound it by meaning.
ROW_LIMIT = "1000000"


def session(app: str = "sheetwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def recursive(spark: SparkSession) -> SparkSession:
    """The session, without Spark's default bound on the rows of a recursion. A bound that someone else set stays."""
    if spark.conf.get("spark.sql.cteRecursionRowLimit") == ROW_LIMIT:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, by any path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, in spark.checkpoint.dir; only where one machine does all the work may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_sheetwise_dir", None) or tempfile.mkdtemp(prefix="sheetwise-")
        spark._sheetwise_dir = base
    return f"{base.rstrip('/')}/sheetwise-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to a shared table and reads them back: the lineage ends at files that outlive executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sheetwise_path = path
    return out


#: Settings that let the planner broadcast a side by its estimated size.
BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
#: Settings under which tables dealt out by job meet where they are, and are written without a sort by bucket.
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.maxConcurrentOutputFileWriters": "16"}


@contextmanager
def by_shuffle(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside meet by a shuffle. The size of compressed files, on which a planner decides, says little of the rows that
    expressions and exploded arrays make of them, and what is broadcast passes the driver whole. Hints still hold.
    """
    inside = dict.fromkeys(BROADCAST, "-1") | CO_LOCATED
    before = {key: spark.conf.get(key, None) for key in inside}
    for key, value in inside.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut_jobs(df: DataFrame, key: str = "job_id") -> DataFrame:
    """cut() into buckets by the key of a job, so that later joins and groupings on a job's rows need no shuffle.

    The rows have to be dealt out by job already, as those made from dealt() tables are; else each task writes a file for each bucket. A
    job's documents are one row each, so its records in one task are no more than the task that parsed them held.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = f"sheetwise_{path[-32:]}"
    with by_shuffle(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._sheetwise_path, out._sheetwise_table = path, name
    return out


def dealt(df: DataFrame) -> DataFrame:
    """A table of cut_jobs() as it is; any other frame dealt out by job and written as one."""
    return df if hasattr(df, "_sheetwise_table") else cut_jobs(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job_id"))


def gather(frames: list[DataFrame]) -> DataFrame:
    """The rows of frames of the same columns in one shared table; each is planned and run by itself, by_shuffle(). A plan of all of them
    at once would be planned anew after each of its stages, whole, on the driver.
    """
    spark, path = frames[0].sparkSession, shared_dir(frames[0].sparkSession)
    with by_shuffle(spark):
        for df in frames:
            df.select(*frames[0].columns).write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(frames[0].schema).parquet(path)
    out._sheetwise_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_sheetwise_path", None):
            spark = df.sparkSession
            if name := getattr(df, "_sheetwise_table", None):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
