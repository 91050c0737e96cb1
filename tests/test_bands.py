import random

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import bands, numbering


def slow(rows, factor):
    """The fold, one row after another."""
    out = {}
    for g in {r[0] for r in rows}:
        found = []
        for _, v, s, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[3])):
            if found and found[-1][1] - v <= factor * max(s, found[-1][2]):
                found[-1][0] += 1
                found[-1][2] = max(found[-1][2], s)
            else:
                found.append([1, v, s])
        out[g] = [tuple(b) for b in found]
    return out


def got(spark, rows, factor, spread):
    df = spark.createDataFrame(rows, "g string, v double, s double, t long").repartition(3)
    out = {}
    for r in sorted(bands.anchored_bands(df, ["g"], F.col("v"), F.col("s"), [F.col("t")], factor, spread).collect(), key=lambda r: r.band):
        assert r.band == len(out.setdefault(r.g, []))
        out[r.g].append((r.members, r.anchor, r.size))
    return out


@pytest.mark.parametrize("spread", [1 << 16, 40])
def test_against_one_row_after_another(spark, spread):
    """Groups in one task and spread ones; sizes that grow inside a band, ties, groups of one value and a null group."""
    rng = random.Random(spread)
    rows, t = [], 0
    for g, n, values, sizes in (("a", 300, lambda: rng.uniform(0, 60), lambda: 1.0), ("b", 300, lambda: rng.uniform(0, 30), lambda: rng.choice([0.1, 0.5, 1, 4])), ("c", 120, lambda: rng.randint(0, 9) * 0.45, lambda: rng.choice([0, 1, 1, 2])),
                                (None, 90, lambda: 7.0, lambda: 1.0), ("e", 5, lambda: rng.uniform(0, 3), lambda: 1.0), ("f", 200, lambda: rng.expovariate(1), lambda: rng.expovariate(1))):
        for _ in range(n):
            t += 1
            rows.append((g, float(values()), float(sizes()), t))
    assert got(spark, rows, 0.45, spread) == slow(rows, 0.45)


def test_rows_without_numbers_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 1.0, 1), ("a", None, 1.0, 2), ("a", nan, 1.0, 3), ("a", 1.0, None, 4), ("a", inf, 1.0, 5), ("a", 0.9, -3.0, 6)]
    for spread in (100, 1):
        assert got(spark, rows, 0.45, spread) == {"a": [(2, 1.0, 1.0)]}
        assert got(spark, [], 0.45, spread) == {}


def test_numbers_of_a_crowded_order(spark):
    """Most rows share the first column, some all of them."""
    df = spark.range(0, 2000, 1, 8).select(F.when(F.col("id") % 10 > 0, "x").alias("a"), F.least(F.col("id"), F.lit(1500)).alias("b"))
    rows = numbering.number_rows(df, [F.col("a").asc_nulls_first(), F.col("b").desc()]).collect()
    assert [r.number for r in sorted(rows, key=lambda r: r.number)] == list(range(1, 2001))
    key = lambda r: (r.a is not None, -r.b)
    assert [key(r) for r in sorted(rows, key=lambda r: r.number)] == sorted(map(key, rows))
    assert numbering.number_rows(df.where("false"), [F.col("b")]).collect() == []
