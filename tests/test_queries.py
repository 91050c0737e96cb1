"""Every query with an oracle against DuckDB on the smallest tables, the optional parts included where present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_join_equals_the_plain_join(spark):
    from pyspark.sql import functions as F

    from sheetwise.operators.overlap import box_pairs, range_join

    a = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), (F.rand(1) * 100).alias("lo_a"), (F.rand(2) * 9).alias("w_a")).withColumn("hi_a", F.col("lo_a") + F.col("w_a"))
    b = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"), (F.rand(3) * 100 - 50).alias("lo_b"), (F.rand(4) * 30).alias("w_b")).withColumn("hi_b", F.col("lo_b") + F.col("w_b"))
    a, b = a.cache(), b.cache()
    plain = a.join(b, "k").where("least(hi_a, hi_b) - greatest(lo_a, lo_b) > 0.00001").select("a", "b")
    fast = range_join(a, b, ["k"], ("lo_a", "hi_a"), ("lo_b", "hi_b")).select("a", "b")
    assert sorted(fast.collect()) == sorted(plain.collect())
    boxes = a.select("k", "a", F.array("lo_a", "w_a", "hi_a", F.col("w_a") + 2).alias("box"))
    rows = boxes.collect()
    want = sorted((x.k, x.a, y.a) for x in rows for y in rows if x.k == y.k and x.a < y.a and all(min(x.box[i + 2], y.box[i + 2]) - max(x.box[i], y.box[i]) > 1e-5 for i in (0, 1)))
    assert sorted(map(tuple, box_pairs(boxes, ["k"], "box", "a").collect())) == want


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from sheetwise.functions import text

    def one(value, fn):
        return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]

    assert one(r"\U+9600\U+95E8\PA\~B\fArial;C\\U+0041", text.decode_markup).startswith("阀门\nA BC")
    assert one("　 a b\t", text.strip) == "a b"
    cases = {("C30 here", "C30"): True, ("C300", "C30"): False, ("C30.5", "C30"): False, ("C30.", "C30"): True, ("xC30", "C30"): False, ("a.C30", "C30"): False, ("(±0.5)", "±0.5"): True, (r"a\Eb c", r"a\Eb"): True}
    for (t, token), want in cases.items():
        got = spark.createDataFrame([(t, token)], "t string, k string").select(text.has_literal(F.col("t"), F.col("k"))).first()[0]
        assert got is want, (t, token)


def test_ulp(spark):
    import math

    from pyspark.sql import functions as F

    from sheetwise.functions.numbers import same_number, ulp

    xs = [1.0, 0.1, 3.0, 1e300, 1e-300, 2.0**52, 2.0**-1000, 7.999999999999999, 8.0, -5.5, 123456.789]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ulp(F.col("x")).alias("u")).collect()
    assert all(r.u == math.ulp(r.x) for r in got)
    pairs = [(1.0, 1.0 + 2**-51, True), (1.0, 1.00001, False), (1e6, math.nextafter(1e6, 2e6), True), (float("nan"), float("nan"), False), (float("inf"), float("inf"), False), (0.0, 1e-13, True)]
    for a, b, want in pairs:
        assert spark.createDataFrame([(a, b)], "a double, b double").select(same_number(F.col("a"), F.col("b"))).first()[0] is want


def test_words_of_all_items(spark, tmp_path):
    import re

    items = [(1, "Turbine rotor casing"), (10, "bearing Turbine"), (13, "gasket flange"), (27, None)]
    texts = ["the turbine Turbine.", "Turbine.5 casing", "xcasing, casing_ (casing)", "gasket.x bearing", "flange.", "a.flange flange9", "écasing", "flange\n", None, "gasket gasket"]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {w for _, t in items for w in re.findall("[A-Za-z]{6,}", t or "")}
    hit = lambda w, t: re.search(rf"(^|[^A-Za-z0-9_.]){w}([^A-Za-z0-9_.]|\Z|\.([^0-9]|\Z))", t or "")
    want = {w: n for w in words if (n := sum(bool(hit(w, t)) for t in texts))}
    assert {"flange", "gasket", "casing"} <= set(want)
    assert dict(map(tuple, entry.queries()["boundary_literal"](spark, str(tmp_path)).collect())) == want


def test_every_row_is_a_circle(spark, tmp_path):
    """Circles of rows whose vec_id is no multiple of ten enclose points too."""
    rows = [(1, [0.0, 0.0], 0), (2, [0.025, 0.0], 0), (3, [0.0, 0.01], 1), (12, [0.5, 0.5], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["nearest_enclosing"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1)]


def test_wide_and_endless_ranges(spark):
    from sheetwise.operators.overlap import range_join

    inf, nan = float("inf"), float("nan")
    a = [(1, 0.0, 1e12), (2, -inf, 5.0), (3, 4.0, 6.0), (4, nan, 9.0), (5, None, 2.0), (6, 1e300, inf), (7, 9.0, 8.0)]
    b = [(1, 3.0, 5.0), (2, -1e15, 1e15), (3, 5.5, inf), (4, 1e11, 1e11 + 1), (5, -inf, inf), (6, 1.0, nan)]
    x = spark.createDataFrame([("k", *r) for r in a], "k string, a long, lo_a double, hi_a double")
    y = spark.createDataFrame([("k", *r) for r in b], "k string, b long, lo_b double, hi_b double")
    good = lambda r: None not in r and r[1] == r[1] and r[2] == r[2] and r[1] <= r[2]
    want = sorted((p[0], q[0]) for p in a for q in b if good(p) and good(q) and min(p[2], q[2]) - max(p[1], q[1]) > 1e-5)
    got = range_join(x, y, ["k"], ("lo_a", "hi_a"), ("lo_b", "hi_b")).select("a", "b").collect()
    assert sorted(map(tuple, got)) == want


def test_boxes_of_mixed_sizes_in_one_block(spark):
    """Dots, thin lines and pages in one key: right pairs, and rows out of the join within a constant of pairs and boxes."""
    import random

    from sheetwise.operators.overlap import grid_join

    rng = random.Random(3)

    def box(i):
        w, h = ((0.01, 0.01), (400.0, 0.2), (0.3, 300.0), (2.0, 1.0))[i % 4] if i % 200 else (900.0, 900.0)
        x, y = rng.uniform(-500, 500), rng.uniform(-500, 500)
        return (x, y, x + w * rng.uniform(0.5, 1), y + h * rng.uniform(0.5, 1))

    rows = [(i, *box(i)) for i in range(1500)]
    make = lambda s: spark.createDataFrame([("k", *r) for r in rows], f"k string, {s} int, {s}0 double, {s}1 double, {s}2 double, {s}3 double")
    share = lambda p, q, i: min(p[i + 2], q[i + 2]) - max(p[i], q[i]) > 1e-5
    want = {(p[0], q[0]) for p in rows for q in rows if share(p, q, 1) and share(p, q, 2)}
    out = grid_join(make("a"), make("b"), ["k"], [("a0", "a2"), ("a1", "a3")], [("b0", "b2"), ("b1", "b3")])
    got = [(r.a, r.b) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan()
    seen, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            seen.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert seen and all(n <= 20 * (len(want) + len(rows)) for n in seen), (seen, len(want))


def test_recursions_have_no_bound_on_rows(spark):
    """Spark's default bound goes, one that a user set stays and is an error."""
    from sheetwise.operators import closure

    key, own = "spark.sql.cteRecursionRowLimit", spark.newSession()
    edges = own.range(40).selectExpr("cast(id AS string) AS parent", "concat('c', id) AS child", "1.0D AS scale", "0.0D AS shift")
    owners = own.range(40).selectExpr("cast(id AS string) AS id")
    own.conf.set(key, "1000000")
    assert closure.closure(edges, owners).count() == 80 and own.conf.get(key) == "-1"
    own.conf.set(key, "50")
    with pytest.raises(Exception, match="RECURSION_ROW_LIMIT"):
        closure.closure(edges, owners).count()
    assert own.conf.get(key) == "50"
