"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, uniform

#: Buckets of the ranking value in each source. Only the bucket that the target falls into is sorted.
BUCKETS = 1 << 12
#: A document's chance of a further copy follows LEAN + floor(log2(size)): within a source, longer documents are
#: somewhat likelier to be repeated, while the source's share of the mix stays what its weight says.
LEAN = 8


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size, weight, target) for each source of a (source, size) frame.

    Sources in code point order, null last, take the weights in turn. All sizes together are shared
    by weight; a target stops at `limit` times its source's size and the excess goes to the others by
    weight, until none is above. In the order of limit * size / weight the capped sources come first,
    so one pass of running sums gives the level at which the sharing ends.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    each = each.withColumn("cap", F.col("source_size") * limit).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    each = each.withColumns(
        {
            "caps": F.sum("cap").over(upto),
            "used": F.sum("weight").over(upto),
            "total": F.sum("source_size").over(everything),
            "all_weights": F.sum("weight").over(everything),
        }
    )
    each = each.withColumn("capped", F.col("caps") + F.col("ratio") * (F.col("all_weights") - F.col("used")) <= F.col("total"))
    held = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    level = (F.col("total") - held) / F.when(free > 0, free)
    return each.select(
        "source", "source_size", "weight",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight"))).alias("target"),
    )


def lean(size: Column) -> Column:
    """The measure that inclusion probabilities are proportional to: 8 for one word, 18 for a thousand."""
    return (F.length(F.bin(F.greatest(size, F.lit(1)))) - 1 + LEAN).cast("long")


def inclusion(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, g, p, rest) for each source and measure g of a (source, size) frame; goal has source, source_size, target and whole.

    p is the probability of one more copy beyond the whole ones: c * g, or 1 where that is above, with c such that the expected
    words are what the whole copies leave of the target. Those with p = 1 are certain; `rest` is what they leave in turn.
    There are at most 64 measures in a source.
    """
    each = sizes.groupBy("source", lean(F.col("size")).alias("g")).agg(F.sum("size").alias("words"))
    each = each.join(goal.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    each = each.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    own, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    leaning = F.col("g") * F.col("words")
    # at the level where this measure's p reaches 1, all measures above are certain and those below have g' / g
    level = F.sum("words").over(upto) + (F.sum(leaning).over(own) - F.sum(leaning).over(upto)) / F.col("g")
    each = each.withColumn("sure", (F.col("left") > 0) & (level <= F.col("left")))
    each = each.withColumn("rest", F.col("left") - F.coalesce(F.sum(F.when(F.col("sure"), F.col("words"))).over(own), F.lit(0)))
    free = F.sum(F.when(~F.col("sure"), leaning).otherwise(0)).over(own)
    part = F.col("rest") / F.when(free > 0, free) * F.col("g")
    return each.select("source", "g", F.when(F.col("sure"), 1.0).otherwise(F.coalesce(F.least(part, F.lit(1 - 1e-12)), F.lit(0.0))).alias("p"), "rest")


RESULT = ("doc_id", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, seed: str = "mix", limit: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for every row, plus the columns in keep.

    A source's share is target / source_size. Its whole part gives each document as many certain copies. One more copy goes to a
    sample with unequal inclusion probabilities p, see inclusion(): probability 1 makes another certain copy, the others are
    ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), in one order for all measures of the source. The
    sample's fixed size is the source's remaining words: rows are taken in rank order up to there, the
    last one if more than half of it fits. The rank value is bucketed; sums by bucket find
    the bucket where the target falls, and only that one is ordered, so a hot source is spread.

    Null texts have size 0, null sources are one source, repeated rows share a draw and rank next to
    each other, an empty table gives no rows. Columns of `keep` that clash with the result's get the prefix in_. Other columns are not read.
    """
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", count.alias("size"), *([F.struct(*keep).alias("_kept")] if keep else [])))  # one column, so that no name clashes
    goal = targets(sized.select("source", "size"), limit=limit)
    goal = cut(goal.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))))
    each = inclusion(sized.select("source", "size"), goal.select("source", "source_size", "target", "whole"))
    each = each.withColumnRenamed("source", "_of").join(goal.select("source", "source_size", "target", "whole"), F.col("_of").eqNullSafe(F.col("source"))).drop("source")
    each = cut(each.withColumnRenamed("g", "_g"))  # at most 64 rows for each source: its size is known to the planner
    rows = sized.withColumn("g", lean(F.col("size"))).join(each, F.col("source").eqNullSafe(F.col("_of")) & (F.col("g") == F.col("_g"))).drop("_of", "_g", "g")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.withColumn("u", uniform("doc_id", seed=seed)).withColumn("q", F.when((F.col("p") > 0) & (F.col("p") < 1), odds))
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))
    # sums by bucket, then the words before each bucket
    sums = ranked.where("q IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    cross = sums.where("before <= rest AND before + words >= rest").groupBy("source").agg(F.max("bucket").alias("edge"), F.max_by("before", "bucket").alias("before"))
    cross = cut(cross.withColumnRenamed("source", "_of"))  # a row for each source
    ranked = ranked.join(cross, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    sure = ranked.where("q IS NULL OR edge IS NULL OR bucket <> edge").withColumn("hit", (F.col("p") >= 1) | F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    inside = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = ranked.where("q IS NOT NULL AND bucket = edge").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("hit", F.col("at") + F.col("size") / 2.0 <= F.col("rest")).drop("at")
    out = sure.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("hit").cast("int")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(F.col("_kept").getField(c).alias(f"in_{c}" if c in RESULT else c) for c in keep))
