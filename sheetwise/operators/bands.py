"""Ordered folds that no window expresses: tolerance bands anchored at their first member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.numbers import finite
from sheetwise.session import cut, drop

from .numbering import number_rows

#: Groups of more rows are spread over tasks.
SPREAD = 1 << 16


def anchored_bands(df: DataFrame, group: list[str], value: Column, size: Column, ties: list[Column], factor: float = 0.45, spread: int = SPREAD) -> DataFrame:
    """(group..., band, members, anchor, size): bands of a group's rows in falling order of value, then of ties.

    A row joins the current band if it is within factor * max(its size, the band's largest) of the
    band's first value; otherwise it opens the next. Rows whose value or size is no finite number take no part; sizes below zero count as zero.

    Groups of at most `spread` rows stream through a fold. In larger ones the row that would end a band is found for every
    row that could begin one, which depends on that row alone; the bands there are those that the first row leads to, found by
    doubling the steps.
    """
    rows = df.select(*group, value.cast("double").alias("_v"), F.when(size.isNotNull(), F.greatest(size.cast("double"), F.lit(0.0))).alias("_s"), *(t.alias(f"_t{i}") for i, t in enumerate(ties)))
    rows = rows.where(finite(F.col("_v")) & finite(F.col("_s")))
    order = [F.col("_v").desc(), *(F.col(f"_t{i}").asc_nulls_first() for i in range(len(ties)))]
    many = cut(rows.groupBy(*group).agg(F.count("*").alias("_n"), F.max("_s").alias("_largest"), F.max("_v").alias("_top")).where(F.col("_n") > spread))
    same = [F.col(f"_m.{g}").eqNullSafe(F.col(f"_r.{g}")) for g in group]
    few = rows.alias("_r").join(many.alias("_m"), same, "left_anti")
    out = _folded(few.repartition(*group).sortWithinPartitions(*group, *order).select(*group, "_v", "_s"), group, factor)
    if many.isEmpty():
        return out
    crowded = rows.alias("_r").join(many.alias("_m"), same).select("_r.*", "_m._n", "_m._largest", "_m._top")
    return out.unionByName(_doubled(crowded, group, order, factor))


def _folded(sorted_rows: DataFrame, group: list[str], factor: float) -> DataFrame:
    """The bands of sorted groups, one row at a time; no group is held."""
    schema = sorted_rows.select(*group).schema.add("band", "integer").add("members", "long").add("anchor", "double").add("size", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = band = None
        for batch in batches:
            done = []
            keys = zip(*(batch.column(g).to_pylist() for g in group)) if group else [()] * batch.num_rows
            for k, v, s in zip(keys, batch.column("_v").to_pylist(), batch.column("_s").to_pylist()):
                if band is not None and k == key and band[2] - v <= factor * max(s, band[3]):
                    band[1] += 1
                    band[3] = max(band[3], s)
                    continue
                if band is not None:
                    done.append((*key, *band))
                band = [band[0] + 1 if band is not None and k == key else 0, 1, v, s]
                key = k
            if done:
                yield _batch(done, batch.schema, group)
        if band is not None:
            yield _batch([(*key, *band)], batch.schema, group)

    return sorted_rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema, group: list[str]) -> pa.RecordBatch:
    kinds = [schema.field(g).type for g in group] + [pa.int32(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [*group, "band", "members", "anchor", "size"])


def band_ends(v: np.ndarray, first: np.ndarray, most: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each run as the first of a band: the run that ends it, len(v) if none does, and the band's largest size.

    v falls strictly; a run has its first row's size and its largest. A band takes in whole stretches as far as its largest
    size so far reaches, so the loop turns once for each time that this size grows.
    """
    n = len(v)
    levels = [most]  # the largest of 2 ** k runs from each on
    while (1 << len(levels)) <= n:
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.maximum(last[: n - 2 * half + 1], last[half : n - half + 1]))

    def largest(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the runs from lo to hi, hi not included, where there are any."""
        out = np.zeros(len(lo))
        k = np.where(hi > lo, np.log2(np.maximum(hi - lo, 1)).astype(int), -1)
        for level in np.unique(k[k >= 0]):
            at = k == level
            out[at] = np.maximum(levels[level][lo[at]], levels[level][hi[at] - (1 << level)])
        return out

    end, size = np.arange(1, n + 1), most.astype(float).copy()
    falling = -v
    open_ = np.arange(n)
    while len(open_):
        j, m = end[open_], size[open_]
        # the bound as a difference of values, which rounding may put one run off
        to = np.maximum(j, np.searchsorted(falling, falling[open_] + factor * m, side="right"))
        while (back := (to > j) & (v[open_] - v[np.minimum(to - 1, n - 1)] > factor * m)).any():
            to = to - back
        while (on := (to < n) & (v[open_] - v[np.minimum(to, n - 1)] <= factor * m)).any():
            to = to + on
        m = np.maximum(m, largest(j, to))
        here = np.minimum(to, n - 1)
        joins = (to < n) & (v[open_] - v[here] <= factor * np.maximum(m, first[here]))
        m = np.where(joins, np.maximum(m, most[here]), m)
        end[open_], size[open_] = to + joins, m
        open_ = open_[joins]
    return end, size


def _doubled(crowded: DataFrame, group: list[str], order: list[Column], factor: float) -> DataFrame:
    """The bands of groups that are too large for one task.

    Rows of one value make a run: its later rows join whatever its first joins or opens. A band reaches factor * the
    group's largest size down at most, so with cells of that height its end is in its own cell, in the next one, or is the first run after both.
    """
    numbered = number_rows(crowded, [*(F.col(g).asc_nulls_first() for g in group), *order], "_row")
    runs = numbered.groupBy(*group, "_v").agg(F.min("_row").alias("at"), F.min_by("_s", "_row").alias("first"), F.max("_s").alias("most"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("_largest", "_top")))
    height = F.greatest(factor * F.col("_largest"), F.lit(1e-300))
    cell = F.least(F.floor((F.col("_top") - F.col("_v")) / height), F.lit(1 << 52)).cast("long")
    runs = runs.withColumn("_cell", cell)
    near = runs.select(*group, "_v", "at", "first", "most", "n", F.explode(F.array(F.struct(F.col("_cell").alias("cell"), F.lit(True).alias("own")), F.struct((F.col("_cell") - 1).alias("cell"), F.lit(False).alias("own")))).alias("_c"))
    near = near.select(*group, F.col("_c.cell").alias("_cell"), F.col("_c.own").alias("own"), "_v", "at", "first", "most", "n")

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        v, at, first, most, n, own = (table.column(c).to_numpy() for c in ("_v", "at", "first", "most", "n", "own"))
        end, size = band_ends(v, first, most, factor)
        after = np.append(at, at[-1] + n[-1])[end]  # past both cells: the row after their last
        keep = pa.array(own)
        out = table.select([*group, "at", "_v"]).append_column("then", pa.array(after)).append_column("size", pa.array(size))
        return out.filter(keep)

    schema = runs.select(*group, "at", F.col("_v").alias("_v")).schema.add("then", "long").add("size", "double")
    steps = cut(near.groupBy(*group, "_cell").applyInArrow(ends, schema))
    firsts = cut(steps.groupBy(*group).agg(F.min("at").alias("then"))).select("then")
    reached = cut(firsts.select(F.col("then").alias("at")))
    jump = cut(steps.select("at", "then").join(steps.select(F.col("at").alias("then")), "then", "left_semi").join(firsts, "then", "left_anti"))  # within a group
    while True:  # after k rounds all bands up to the 2 ** k-th are known
        after = cut(reached.union(reached.join(jump, "at").select("then")).distinct())
        longer = cut(jump.select("at", F.col("then").alias("_mid")).join(jump.select(F.col("at").alias("_mid"), "then"), "_mid").select("at", "then"))
        drop(reached, jump)
        reached, jump = after, longer
        if longer.isEmpty():
            break
    found = number_rows(steps.join(reached, "at"), [F.col("at")], "_band")
    least = found.groupBy(*group).agg(F.min("_band").alias("_least"))
    same = [F.col(f"f.{g}").eqNullSafe(F.col(f"l.{g}")) for g in group]
    out = found.alias("f").join(least.alias("l"), same)
    return out.select(*(F.col(f"f.{g}").alias(g) for g in group), (F.col("_band") - F.col("_least")).cast("int").alias("band"), (F.col("then") - F.col("at")).alias("members"), F.col("_v").alias("anchor"), "size")
