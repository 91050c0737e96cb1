"""Consecutive numbers in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.session import cut

#: Bits of Spark's increasing ids that count inside a partition.
INSIDE = 33


def number_rows(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Adds 1, 2, ... in an order that should be total; of rows that tie any may come first.

    Rows go to ranges of the order, so a crowded value of the first column is parted by the next ones. They are written once,
    numbered in their range, and shifted by the sizes of the ranges before: one row for each range meets in one task.
    """
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_number_at", F.monotonically_increasing_id()))
    part = F.shiftright("_number_at", INSIDE)
    before = Window.orderBy("_number_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranges.groupBy(part.alias("_number_part")).agg(F.count("*").alias("_n")).select("_number_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_number_shift"))
    out = ranges.join(F.broadcast(shifts), part == F.col("_number_part"))
    return out.withColumn(name, F.col("_number_shift") + F.col("_number_at").bitwiseAND((1 << INSIDE) - 1) + 1).drop("_number_at", "_number_part", "_number_shift")
