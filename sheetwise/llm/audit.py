"""How quality filters overlap: a histogram of failure masks, and every order of the filters read off it.

Each document gets one bit for each filter that it fails. Of a part's documents only the 32 counts of masks
matter for any order of five filters, so the table is read once, and orders are enumerated on the counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

FILTERS = "ABCDE"
#: Fewer words than MIN_WORDS fail A; fewer than half of the words distinct fails B; over 3 % of capitals fail C; one of SYMBOLS fails D.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters that see one text only. Null counts as empty; an empty text fails A alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        capitals * 100 > F.length(text) * CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    )
    out = F.lit(0)
    for bit, fail in enumerate(fails):
        out = out + F.when(fail, 1 << bit).otherwise(0)
    return out


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic): a row for each row of docs, whose doc_id, text and lang are read.

    Bit 4 (E) is set if a row of a smaller doc_id has the same text, null counting as empty. Texts are compared by SHA-256. A null
    doc_id is smaller than none and has none before it. The least doc_id of a text is found with partial sums and goes back to
    the one row that it names, so a text with many copies meets nowhere. good and toxic are 1 where a label of the doc_id says so;
    several labels count once.
    """
    facts = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        text_mask(F.col("text")).alias("own"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"),
    )
    digests = docs.select(F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_digest"))
    first = digests.where("_id IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_id"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of"))
    marks = marks.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}") for c in ("quality", "toxic")))
    told = facts.join(first, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").join(marks, F.col("doc_id") == F.col("_of"), "left")
    later = F.col("doc_id").isNotNull() & F.col("_digest").isNull()
    return told.select(
        "doc_id",
        "part",
        (F.col("own") + F.when(later, 16).otherwise(0)).alias("mask"),
        F.coalesce("_quality", F.lit(0)).alias("good"),
        F.coalesce("_toxic", F.lit(0)).alias("toxic"),
    )


def histogram(masked: DataFrame) -> DataFrame:
    """(part, cells): for each part the structs mask, n, good, toxic of the masks that occur, 32 at most."""
    cells = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _total(where: str, count: str = "c.n") -> Column:
    """The sum of a count over the cells c with a condition."""
    return F.expr(f"aggregate(cells, 0L, (t, c) -> t + IF({where}, {count}, 0L))")


def orders(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the histogram alone.

    A filter's shapley counts the documents that it removes in all 120 orders: one that fails k filters is removed by each of
    them in 120 / k.
    """
    every = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    rows = cells.select("part", "cells", F.explode(every).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    at = [F.instr("filter_order", f) for f in FILTERS]
    rows = rows.withColumns(
        {
            "before": sum((F.when(a < F.col("step"), 1 << i).otherwise(0) for i, a in enumerate(at)), F.lit(0)),
            "now": sum((F.when(a == F.col("step"), 1 << i).otherwise(0) for i, a in enumerate(at)), F.lit(0)),
        }
    )
    gone = "c.mask & before <> 0"
    fails = "c.mask & now <> 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        _total(f"NOT {gone} AND NOT {fails}").alias("kept"),
        _total(f"NOT {gone} AND {fails}").alias("removed"),
        _total(f"{gone} AND {fails}").alias("redundant"),
        _total("c.mask = now").alias("unique_fails"),
        _total(f"NOT {gone} AND {fails}", "c.good").alias("good_lost"),
        _total(f"NOT {gone} AND {fails}", "c.toxic").alias("toxic_lost"),
        _total(fails, f"c.n * ({factorial(len(FILTERS))} div bit_count(c.mask))").alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all rows of docs: for each part, order and step what the step keeps, removes and repeats.

    docs has doc_id, text and lang, labels has doc_id, quality and toxic; other columns are not read. A null lang is the
    part of the empty string. Repeated rows count each. Without rows there is no part.
    """
    return orders(histogram(masks(docs, labels)))
