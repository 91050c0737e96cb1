"""Nested definitions: levels of a graph of references, every placement of a block in its owners, and chains that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.session import cut, drop, recursive

#: Levels of nesting after which a chain is reported rather than followed.
DEPTH = 64


def peel(edges: DataFrame, on: list[str] | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the parents in edges (on..., parent, child), and the edges on cycles or above them.

    At level 0 are the parents whose children have no references, and so on; each is (on..., parent). A round takes off all
    parents of a level, with sums for each, so the work is that of the edges times the levels, however many
    paths there are. What is left when no parent can be taken leads into a cycle.
    """
    on = on or []
    left = cut(edges.select(*on, "parent", "child").where("child IS NOT NULL").distinct())
    levels: list[DataFrame] = []
    while True:
        owners = left.select(*on, F.col("parent").alias("child"), F.lit(True).alias("_open")).distinct()
        state = left.join(owners, [*on, "child"], "left").groupBy(*on, "parent").agg(F.coalesce(F.bool_or("_open"), F.lit(False)).alias("open"))
        state = cut(state)
        ready = state.where("NOT open").select(*on, "parent")
        if ready.isEmpty():
            drop(state)
            return levels, left
        levels.append(ready)
        rest = cut(left.join(state.where("open"), [*on, "parent"], "left_semi"))
        drop(left)
        left = rest


def closure(edges: DataFrame, owners: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(owner, block, scale, shift, depth) of every owner and all blocks below it, a row for each way there.

    edges: (parent, child, scale, shift), a child's coordinate x becoming scale * x + shift in its
    parent, once for each reference. A block without references is its own only placement. References on cycles
    or that lead into one are not followed; `endless` has them. The recursion stays in one plan.
    """
    spark = recursive(edges.sparkSession)
    _, loops = peel(edges)
    sound = edges.join(loops.select("parent").distinct(), "parent", "left_anti")
    return spark.sql(
        f"""WITH RECURSIVE placed(owner, block, scale, shift, depth) MAX RECURSION LEVEL {depth} AS (
              SELECT id, id, 1.0D, 0.0D, 0 FROM {{owners}}
              UNION ALL
              SELECT p.owner, e.child, p.scale * e.scale, p.scale * e.shift + p.shift, p.depth + 1 FROM placed p JOIN {{edges}} e ON e.parent = p.block)
            SELECT * FROM placed""",
        owners=owners,
        edges=sound,
    )


def endless(edges: DataFrame, owners: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(owner, meets, steps): chains of references from an owner that meet a block twice, and after how many steps. Only what peel() leaves is followed."""
    spark = recursive(edges.sparkSession)
    _, loops = peel(edges)
    return spark.sql(
        f"""WITH RECURSIVE chain(owner, block, path, cyclic) MAX RECURSION LEVEL {depth} AS (
              SELECT id, id, array(id), false FROM {{owners}}
              UNION ALL
              SELECT c.owner, e.child, array_append(c.path, e.child), array_contains(c.path, e.child) FROM chain c JOIN {{edges}} e ON e.parent = c.block WHERE NOT c.cyclic)
            SELECT owner, block AS meets, size(path) - 1 AS steps FROM chain WHERE cyclic""",
        owners=owners.join(loops.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"),
        edges=loops,
    )
