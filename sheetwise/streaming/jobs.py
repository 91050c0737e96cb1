"""Arriving job folders as a stream: an extension; the batch operators do the work in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetwise.operators import contracts
from sheetwise.sources import schemas


def arriving(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON documents as they arrive, one row each, with job_id and the file's time as `arrived`."""
    read = spark.readStream.schema(schema + ", _corrupt_record string").option("multiLine", True).json(pattern)
    return read.withColumns({"job_id": F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1), "arrived": F.col("_metadata.file_modification_time")})


def receipts_by_window(receipts: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Numbers of receipts by status in windows of arrival, with bounded state."""
    return receipts.withWatermark("arrived", late).groupBy(F.window("arrived", window), "status").count()


def validate_arriving(spark: SparkSession, sources: str, mappings: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Validates each arriving mapping against its job's snapshot and hands the violations of a micro-batch to the sink."""

    def check(batch: DataFrame, epoch: int) -> None:
        batch = batch.drop("arrived").persist()
        source = spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).json(sources)
        source = source.withColumn("job_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).join(batch.select("job_id").distinct(), "job_id", "left_semi")
        sink(contracts.validate(source, batch), epoch)
        batch.unpersist()

    stream = arriving(spark, mappings, schemas.MAPPING)
    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
