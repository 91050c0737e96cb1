import math

import numpy as np
import pytest

from sheetwise.llm import common, vectors
from sheetwise.llm.queries import QUERIES

from .conftest import reach

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
             and (lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b)))(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= cosine]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    comp = reach(range(len(rows)), links)
    least = {}
    for i, c in comp.items():
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n[i], least[comp[i]], rows[i][0] == least[comp[i]]) for i in range(len(rows)))


def clusters(seed, dims=24):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for _ in range(12):
        base = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 20))):
            v = base + rng.standard_normal(dims) * rng.choice([0.0, 0.05, 0.1, 0.15, 0.2, 0.25])
            rows.append((k, np.float32(v * rng.choice([1, 3])).tolist(), int(rng.integers(0, 2))))
            k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * dims, 1), (k + 2, [float("nan")] * dims, 1), (k + 3, [None] * dims, 0), (k + 4, rows[0][1], None), (k + 5, rows[0][1][:5], rows[0][2]), (k + 6, [], 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(vectors, "SIDE", 4)  # splits every cell
    rows = clusters(seed)
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, QUERIES["op3_vector_near_dup"](spark, sf).select("vec_id", "n_links", "component_id", "kept").collect())) == brute(rows)


def test_empty_and_repeated(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = vectors.near_duplicates(spark.createDataFrame([(7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (3, [2.0, 4.0], 1)], SCHEMA))
    assert sorted(map(tuple, got.collect())) == [(3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False)]


def test_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((4, 4000))
    rows = [(i, np.float32(base[i % 4] + 0.1 * rng.standard_normal(4000) * (i > 3)).tolist(), 1) for i in range(16)]
    df = spark.createDataFrame([(*r, 5, "x", 2) for r in rows], SCHEMA + ", cid int, cell string, weight int")
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == brute(rows)


def test_popular_keys_are_joined_apart(spark):
    rows = spark.range(5000).selectExpr("id AS v", "CASE WHEN id < 4000 THEN 7 WHEN id < 4900 THEN id END AS k")
    facts = rows.where("k IS NOT NULL AND k <> 4001").groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS w").cache()
    got = common.spread_join(rows, facts, "k", "n", 5000)
    assert set(got.columns) == {"v", "k", "w"}
    want = sorted((v, 14 if v < 4000 else v * 2 if v < 4900 and v != 4001 else None) for v in range(5000))
    assert sorted(map(tuple, got.select("v", "w").collect())) == want


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.12).tolist(), 1) for i in range(60)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
