"""Helpers of the training-data operators: shared storage, text vectors and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in spark.checkpoint.dir. Only where that is unset and one machine does all the work, as in tests, a local
    one is made; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_sheetwise_dir", None) or tempfile.mkdtemp(prefix="sheetwise-")
        spark._sheetwise_dir = base
    return f"{base.rstrip('/')}/sheetwise-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the rows to a shared table and reads them back: the lineage ends at replicated files."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sheetwise_path = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like cut(), in hash buckets of a key: a join on it moves the other side only."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"sheetwise_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._sheetwise_path, out._sheetwise_table = path, name
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by cut() and bucketed() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_sheetwise_path", None)
        if name := getattr(df, "_sheetwise_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: A key is popular if more than one in so many rows has it; so there are fewer than that many popular keys.
POPULAR = 1024


def spread_join(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """A left join of rows with facts about keys, without a task that holds all rows of a popular key.

    facts is a table read several times, with one row for each key; its column `size`, which is dropped, says how many of the
    `total` rows have the key. Facts of popular keys, fewer than POPULAR rows at any input, are broadcast; the other
    rows meet by a shuffle. Rows without a key take no part in either.
    """
    heavy = facts.where(F.col(size) * POPULAR > F.lit(total)).drop(size)
    light = facts.where(F.col(size) * POPULAR <= F.lit(total)).drop(size)
    there = rows.where(F.col(key).isNotNull())
    rest = there.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    out = there.join(F.broadcast(heavy), key).unionByName(rest)
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, or a longer one that no column of the frames has, whatever the case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """df, after Arrow batches were brought to BATCH_ROWS rows where the session has Spark's default of 10000.

    Rows hold whole texts or vectors here, and a batch is held several times over between the JVM and a Python worker.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text at most, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and n + 1 offsets into them; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. After a given number of rounds
    only, some node reachable that many others have as well.

    Alternating large-star and small-star rounds. Each is an aggregation with partial sums and a
    join on the node, so a hub is pre-aggregated and its rows can be split; no links reach the driver.
    """
    now = cut(
        edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    )
    sign = None if rounds else _signature(now)
    turn = 0
    while True:
        turn += 1
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = cut(small)
        sign2 = None if rounds else _signature(after)
        drop(now)
        now = after
        if turn == rounds or not rounds and sign2 == sign:
            break
        sign = sign2
    nodes = now.select("u", "v").union(now.select(F.col("v").alias("u"), "v"))
    return nodes.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) % 1000003 AS long))")).first()
    return tuple(row)


def uniform(*parts: Column | str, seed: str = "") -> Column:
    """A reproducible draw strictly between 0 and 1 for each row, from 52 bits of an MD5 digest.

    Arguments are joined with a colon; null counts as the text null.
    """
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def sample(rows: DataFrame, n: int, budget: int, seed: str, ids: DataFrame | None = None) -> DataFrame:
    """A sample of whole rows for fitting, chosen in the order of a draw by doc_id: n rows and `budget` bytes of text at most.

    rows has doc_id and text; the draw is added as _draw, the row's hash as _key. With `ids`, a frame of one column, only rows with
    one of its n smallest draws count. Repeated rows count once. Rows are taken in order as long as they fit, none in part, so only
    a text longer than the whole budget has no chance. Sizes are compared before any text is moved, and no text is shuffled but
    those taken; none reaches the driver.
    """
    keyed = rows.withColumns({"_key": F.xxhash64("doc_id", "text"), "_draw": uniform("doc_id", seed=seed)})
    if ids is not None:
        some = ids.toDF("_id").where("_id IS NOT NULL").distinct()
        some = some.orderBy(uniform("_id", seed=seed), "_id").limit(n).collect()  # n ids
        keyed = keyed.join(F.broadcast(rows.sparkSession.createDataFrame(some, ids.toDF("_id").schema)), F.col("doc_id") == F.col("_id"), "left_semi")
    light = keyed.select("_draw", "_key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes")).distinct()
    chosen, used = [], 0
    for r in light.orderBy("_draw", "_key").limit(n).collect():
        if used + r["_bytes"] <= budget:
            used += r["_bytes"]
            chosen.append((r["_key"],))
    wanted = rows.sparkSession.createDataFrame(chosen, "_key long")  # n keys
    return keyed.join(F.broadcast(wanted), "_key").groupBy("_key").agg(*(F.first(c).alias(c) for c in ("_draw", *rows.columns)))


def in_order(found: pa.Table) -> list[dict]:
    """The rows of a sample in the order of their draws."""
    return sorted(found.to_pylist(), key=lambda r: (r["_draw"], r["_key"]))


def sample_rows(rows: DataFrame, n: int, budget: int, seed: str, ids: DataFrame | None = None) -> list[dict]:
    """A sample() as rows on the driver, in the order of their draws. Models are fitted in a task instead."""
    return in_order(sample(rows, n, budget, seed, ids).toArrow())


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many, where rows of one key, neighbours in a sorted partition, are never parted. For keys with few rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = whole.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        while at < len(keys):
            end = starts[np.searchsorted(starts, at + rows) - 1] if len(starts) and starts[0] <= at + rows else -1
            if end <= at:  # one key has more rows
                later = starts[starts > at]
                end = later[0] if len(later) else -1
            if end < 0 or end > starts[-1]:
                break
            yield whole.slice(at, end - at)
            at = int(end)
        held = [whole.slice(at)]
    yield from held
