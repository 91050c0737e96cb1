"""The corpus pipeline: quality, one of each group of near copies, personal data, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import jaccard, mix, packing, pii, quality
from sheetwise.llm.common import cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled ones among docs that are not held out."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by similar shingles, one row: that with the smallest doc_id, null last.

    Rows are told apart by a number of their own, so of two different texts under one doc_id both stay, a repeated row goes, and a
    null doc_id is compared like any other. Rows without words link with nothing, and all stay.
    """
    rows = cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    groups = jaccard.similar(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_of"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    kept = rows.select("doc_id", "_row").join(groups, F.col("_row") == F.col("_of")).groupBy("component_id").agg(first.alias("first"))
    return rows.join(kept.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    field = pii.fit(docs)
    out = pii.find(docs, field, keep=COLUMNS, redact=True)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies of it."""
    taken = mix.mix(docs, keep=("text", "lang", "source", "n_chars"))
    copies = taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", unique),
    ("personal data", private),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: Compression, the field and tokenization cannot be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
