"""The engine's own queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.operators import numbering, units
from sheetwise.session import table

from . import records, relational, snapshots, spatial  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, register

__all__ = ["ORACLES", "QUERIES"]


@register(
    "exact_dedup_packet",
    """SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS occurrences,
              max(length(text)) AS n_chars
       FROM documents WHERE text IS NOT NULL GROUP BY text""",
)
def exact_dedup_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per distinct text: its first document and how often it occurs.

    Grouping by the digest keeps long texts out of the shuffle.
    """
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return (
        docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").cast("long").alias("n"))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("occurrences"), F.max("n").alias("n_chars"))
    )


@register(
    "packet_membership",
    """WITH f AS (SELECT text, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text),
            e AS (SELECT *, row_number() OVER (ORDER BY first_doc) AS e FROM f)
       SELECT doc_id, format('text-{:06d}', e) AS id, first_doc, n AS occurrences, length(e.text) AS n_chars FROM documents d JOIN e ON d.text = e.text""",
)
def packet_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units of a packet: each one's entry, in first-seen order, with the entry's first document, size and text length."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("source"))
    numbered = numbering.number_rows(docs, [F.col("doc_id")])
    unit = numbered.select("number", F.col("doc_id").cast("string").alias("id"), "source", F.lit("B").alias("block"), *(F.lit(None).cast(t).alias(c) for c, t in (("region", "string"), ("box", "array<double>"), ("height", "double"), ("review", "string"))))
    entries, occurrences = units.packet_tables(unit)
    first = numbered.select(F.col("number").alias("first"), F.col("doc_id").alias("first_doc"))
    told = entries.join(first, "first").select("id", "first_doc", F.col("n").alias("occurrences"), F.length("source").cast("long").alias("n_chars"))
    return occurrences.select(F.col("unitId").cast("long").alias("doc_id"), "id").join(told, "id")
