"""Ruled lines of snapshots: straight edges of lines and polylines, carried through nested block references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.numbers import finite, transform_point
from sheetwise.session import cut
from sheetwise.sources.artifacts import section

from .closure import peel
from .units import straight


def segments(geometry: DataFrame) -> DataFrame:
    """(job_id, block, a, b): edges of visible lines and polylines; a bulged edge is none."""
    shown = geometry.where("visible IS NOT FALSE").withColumn("block", F.coalesce("block", F.lit("None")))
    bare = "coalesce(to_json(shape), 'null') IN ('null', '{}')"
    line = shown.where("type = 'AcDbLine'").select(
        "job_id", "block", *(F.expr(f"CASE WHEN {bare} THEN {c} ELSE try_variant_get(shape, '$.{c}', 'array<double>') END AS {c}") for c in "ab")
    )
    poly = shown.where("type = 'AcDbPolyline'").selectExpr("job_id", "block", "try_variant_get(shape, '$.vertices', 'array<variant>') AS v", "coalesce(try_variant_get(shape, '$.closed', 'boolean'), false) AS closed")
    place = "coalesce(try_variant_get(x, '$.p', 'array<double>'), try_variant_get(x, '$.point', 'array<double>'), try_variant_get(x, '$', 'array<double>')) AS p"
    poly = poly.selectExpr("job_id", "block", "closed", f"transform(v, x -> struct({place.removesuffix(' AS p')} AS p, coalesce(try_variant_get(x, '$.bulge', 'double'), 0) AS bulge)) AS v")
    poly = poly.selectExpr("job_id", "block", "explode(transform(v, (x, i) -> struct(x.bulge AS bulge, x.p AS a, CASE WHEN i + 1 < size(v) THEN v[i + 1].p WHEN closed THEN v[0].p END AS b))) AS e")
    return line.union(poly.where("e.bulge = 0").select("job_id", "block", "e.a", "e.b")).where("size(a) >= 2 AND size(b) >= 2")


def references(geometry: DataFrame, blocks: DataFrame) -> DataFrame:
    """(job_id, handle, parent, child, matrix) of visible references to known blocks."""
    names = blocks.groupBy("job_id", F.upper("handle").alias("definition")).agg(F.max_by("name", "ordinal").alias("child"))
    made = geometry.where("type = 'AcDbBlockReference' AND visible IS NOT FALSE").selectExpr(
        "job_id", "handle", "coalesce(block, 'None') AS parent", "upper(try_variant_get(shape, '$.definition', 'string')) AS definition", "try_variant_get(shape, '$.matrix', 'array<double>') AS matrix"
    )
    return made.join(names, ["job_id", "definition"]).drop("definition")


def expanded(snapshots: DataFrame) -> DataFrame:
    """(job_id, block, a, b): each block's own edges and those of all blocks it refers to, in its coordinates.

    Blocks are expanded by levels, the innermost first, so one that many refer to is expanded once, and a point goes
    through the matrices one by one. A matrix that is not 16 finite numbers and a cycle of references are errors.
    """
    geometry, blocks = section(snapshots, "geometry"), section(snapshots, "blocks")
    own, refs = cut(segments(geometry)), cut(references(geometry, blocks))
    bad = refs.where(~F.coalesce((F.size("matrix") == 16) & F.forall("matrix", finite), F.lit(False))).select("handle").first()
    if bad:
        raise ValueError(f"matrix of block reference {bad.handle} needs review")
    levels, loops = peel(refs, ["job_id"])
    loop = loops.select("parent").first()
    if loop:
        raise ValueError(f"cyclic references of block {loop.parent}")
    z = lambda p: F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))
    moved = lambda c: transform_point(F.col("matrix"), F.get(c, F.lit(0)), F.get(c, F.lit(1)), z(c)).alias(c)
    out = own
    for parents in levels:
        placed = refs.join(parents, ["job_id", "parent"], "left_semi").join(out.withColumnRenamed("block", "child"), ["job_id", "child"])
        out = out.union(cut(placed.select("job_id", F.col("parent").alias("block"), moved("a"), moved("b"))))
    return out


def barriers(snapshots: DataFrame) -> DataFrame:
    """(job_id, block, kind, at, lo, hi): the upright and level edges that build_units() takes, for one snapshot at a time."""
    x = lambda c, i: F.get(c, F.lit(i))
    flat = expanded(snapshots).select("job_id", "block", x("a", 0).alias("x0"), x("a", 1).alias("y0"), x("b", 0).alias("x1"), x("b", 1).alias("y1"))
    return straight(flat, ["job_id", "block"])
