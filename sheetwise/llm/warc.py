"""A content-addressed WARC archive: payload bytes once by digest, record headers apart."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop

CRLF = "\r\n"
#: Shorter payloads are stored once too, but each of their records stays a response.
LEAST_BYTES = 100
#: Fixed value: the profile of revisits that name an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(*fields: tuple[str, Column]) -> Column:
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF))


def _one_line(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, captured: datetime | None = None) -> None:
    """Writes path/payloads (digest, payload) and path/records (digest, header), a record for each row.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of least_bytes at
    least, that with the smallest page_id is the response and the others are revisits of it; of
    repeated rows with that page_id each is a response. A null page_id sorts last. Payloads are stored once by
    partial aggregation on the digest, so copies meet as one row per task. Other columns are not read.

    A record's id is made of its page_id and digest, with a number where both repeat, so ids are unique and a revisit refers to a
    record that exists. `captured` is the date of all records, by default the time of the call: pages have none of their own.
    An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    date = (captured or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    light = cut(rows.select("page_id", "url", "digest", "n", F.monotonically_increasing_id().alias("row")))
    # tables of their own, so that the join can split a popular digest
    first = cut(light.groupBy("digest").agg(F.min("page_id").alias("first_id")).withColumnRenamed("digest", "_digest"))
    twice = light.groupBy("page_id", "digest").agg(F.count("*").alias("k"), F.min("row").alias("lead")).where("k > 1")
    twice = cut(twice.select(F.col("page_id").alias("_id"), F.col("digest").alias("_of"), "lead"))
    records = light.join(first, F.col("digest") == F.col("_digest")).drop("_digest")
    records = records.join(twice, (F.col("digest") == F.col("_of")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    revisit = (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"))
    again = F.when(F.col("lead") != F.col("row"), F.concat(F.lit(":"), F.col("row").cast("string")))
    header = _header(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.concat(name(F.col("page_id")), F.coalesce(again, F.lit("")), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _one_line(F.coalesce("url", F.lit("")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, F.concat(name(F.col("first_id")), F.lit(">")))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
    )
    records.select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    drop(light, first, twice)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _checked(digest: Column, payload: Column, value: Column) -> Column:
    """The value, or an error if the payload does not have the digest that it is addressed by."""
    return F.when(F.sha2(payload, 256).eqNullSafe(digest), value).otherwise(F.raise_error(F.concat(F.lit("damaged or missing payload "), digest)))


def read_archive(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A row for each record, parsed from its header, joined with its payload's length and fresh digest.

    The join carries lengths and digests only, so a payload that many records share is not multiplied. A payload whose bytes do
    not have the digest that its records name, or that is missing, is an error; with strict=False its records have `verified`
    false instead.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    number = lambda name: F.regexp_extract(_field(name), r"^<urn:page:(-?\d+):", 1).try_cast("long")
    records = spark.read.parquet(f"{path}/records").withColumn("head", F.decode("header", "UTF-8"))
    records = records.select(
        number("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("named"), number("WARC-Refers-To").alias("refers_to"),
    )
    sound = F.coalesce(F.col("named") == F.col("payload_digest"), F.lit(False))
    if strict:
        sound = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged or missing payload "), F.col("named"))).cast("boolean"))
    return records.join(stored, F.col("named") == F.col("_digest"), "left").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", sound.alias("verified"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): each record's bytes as in a WARC file, and `payload`, in full for revisits too. A damaged payload is an error."""
    payloads = spark.read.parquet(f"{path}/payloads").withColumnRenamed("digest", "_digest")
    payloads = payloads.withColumn("payload", _checked(F.col("_digest"), F.col("payload"), F.col("payload")))
    records = spark.read.parquet(f"{path}/records").withColumn("head", F.decode("header", "UTF-8"))
    end = F.lit(CRLF + CRLF).cast("binary")
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.join(payloads, F.col("digest") == F.col("_digest")).select(
        F.regexp_extract(_field("WARC-Record-ID"), r"(-?\d+)", 1).try_cast("long").alias("page_id"), F.concat("header", body, end).alias("record"), "payload"
    )
