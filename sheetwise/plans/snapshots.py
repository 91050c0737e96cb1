"""Snapshots made from the driver's tables, so that the operators on drawings run on whole tables against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.operators import diff, grid, members
from sheetwise.session import table
from sheetwise.sources import schemas

from .registry import register


@register(
    "joined_text",
    """WITH e AS (SELECT user_id, event_type, value AS y, (epoch_us(ts) / 3600000000.0::DOUBLE) % 24 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
            l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM e WINDOW w AS (PARTITION BY user_id ORDER BY place))
       SELECT user_id, string_agg(CASE WHEN place = 1 OR (abs(py - y) <= 0.45::DOUBLE AND x - (px + 0.5::DOUBLE) BETWEEN -0.35::DOUBLE AND 1.6::DOUBLE) THEN '' ELSE chr(10) END || event_type, '' ORDER BY place) AS source
       FROM l GROUP BY user_id""",
)
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, read as fragments of one target, as the text they make: the value is a baseline, the time of day a position."""
    x = (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0) % 24
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    parts = table(spark, sf_dir, "events").select(
        "user_id", place.alias("place"), F.lit("TEXT").alias("kind"), F.col("event_type").alias("raw"), F.lit(None).cast("string").alias("visibleText"), F.lit("Model").alias("block"), F.lit(1.0).alias("height"),
        F.lit(0.0).alias("rotation"), F.array(x, F.col("value")).alias("position"), F.array(x, F.col("value"), x + 0.5, F.col("value") + 1.0).alias("box"),
    )
    return members.joined_text(parts, ["user_id"])


@register(
    "shape_diff",
    """SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 31 = 0 AND o_orderstatus <> 'X' THEN 's' END, CASE WHEN o_orderkey % 5 = 0 THEN 'p' END,
              CASE WHEN o_orderkey % 11 = 0 THEN 'n/c' END, CASE WHEN o_orderkey % 7 = 0 THEN 'n/l/1' END], lambda x: x IS NOT NULL)) AS path FROM orders""",
)
def shape_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the nested shapes of orders differ from a changed copy: another text, a price beyond and within rounding, another type, a missing element."""
    n = "named_struct('c', {c}, 'l', {l})"
    shape = lambda s, p, c, e: f"to_variant_object(named_struct('s', {s}, 'p', {p}, 'n', {n.format(c=c, l=e)}))"
    full, part, key = "array(1, o_custkey % 7)", "array(1)", "o_orderkey"
    status = f"CASE WHEN {key} % 31 = 0 THEN 'X' ELSE o_orderstatus END"
    price = f"o_totalprice * (1 + CASE WHEN {key} % 5 = 0 THEN 1e-9D WHEN {key} % 3 = 0 THEN 1e-16D ELSE 0D END)"
    changed = " ".join(f"WHEN {key} % 11 {a} 0 AND {key} % 7 {b} 0 THEN {shape(status, price, c, e)}" for a, c in (("=", "cast(o_custkey AS string)"), ("<>", "o_custkey")) for b, e in (("=", part), ("<>", full)))
    orders = table(spark, sf_dir, "orders")
    before = orders.selectExpr(key, f"{shape('o_orderstatus', 'o_totalprice', 'o_custkey', full)} AS shape")
    after = orders.selectExpr(key, f"CASE {changed} END AS shape")
    out = diff.unequal_shapes(before, after, [key], "shape")
    return out.select(key, F.replace(F.substring("path", 2, 1 << 30), F.lit(diff.STEP), F.lit("/")).alias("path"))


@register(
    "grid_edges",
    """WITH e AS (SELECT r_name AS job_id, n_regionkey AS r, n_nationkey AS n, unnest([0.0::DOUBLE, 8.0::DOUBLE]) AS x0, 2.0::DOUBLE AS y0, unnest([8.0::DOUBLE, 8.0::DOUBLE]) AS x1, unnest([2.0::DOUBLE, 5.0::DOUBLE]) AS y1
                  FROM nation JOIN region ON n_regionkey = r_regionkey)
       SELECT job_id, 'N' || n AS block, x0, y0, x1, y1 FROM e
       UNION ALL SELECT job_id, 'MID', x0 + n, y0, x1 + n, y1 FROM e
       UNION ALL SELECT job_id, 'TOP', 10 * r - y0, x0 + n, 10 * r - y1, x1 + n FROM e""",
)
def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines of nations' blocks, shifted into a block of their region that stands turned in the sheet: each region is a job."""
    sides = [f"1D,0D,0D,{m},0D,1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D" for m in ("cast(n_nationkey AS double)",)] + ["0D,-1D,0D,10D*r_regionkey,1D,0D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D"]
    ref = "named_struct('handle', {h}, 'type', 'AcDbBlockReference', 'block', {b}, 'shape', to_json(named_struct('definition', {d}, 'matrix', array({m}))))"
    line = "named_struct('handle', concat('e', n_nationkey), 'type', 'AcDbPolyline', 'block', concat('N', n_nationkey), 'shape', to_json(named_struct('vertices', array(named_struct('p', array(0D, 2D), 'bulge', 0D), named_struct('p', array(8D, 2D), 'bulge', 0D), named_struct('p', array(8D, 5D), 'bulge', 1D)))))"
    own = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = own.groupBy("r_name", "r_regionkey").agg(
        F.flatten(F.collect_list(F.expr("array(" + line + ", " + ref.format(h="concat('r', n_nationkey)", b="'MID'", d="concat('b', n_nationkey)", m=sides[0]) + ")"))).alias("own"),
        F.collect_list(F.expr("named_struct('handle', concat('B', n_nationkey), 'name', concat('N', n_nationkey))")).alias("names"),
    )
    per = per.selectExpr(
        "r_name AS job_id", "concat(own, array(" + ref.format(h="'t'", b="'TOP'", d="'mid'", m=sides[1]) + ")) AS geometry", "concat(names, array(named_struct('handle', 'MID', 'name', 'MID'), named_struct('handle', 'TOP', 'name', 'TOP'))) AS blocks"
    )
    typed = dict(part.strip().replace("`", "").split(" ", 1) for part in schemas.GEOMETRY.split(", "))
    fill = lambda alias, known, ddl: "named_struct(" + ", ".join(f"'{c}', " + (f"parse_json({alias}.{c})" if t == "variant" and c in known else f"{alias}.{c}" if c in known else f"cast(NULL AS {t})") for c, t in ddl.items()) + ")"
    snapshots = per.selectExpr("job_id", f"transform(geometry, g -> {fill('g', ('handle', 'type', 'block', 'shape'), typed)}) AS geometry", "blocks")
    at = lambda c, i, name: F.get(c, F.lit(i)).alias(name)
    return grid.expanded(snapshots).select("job_id", "block", at("a", 0, "x0"), at("a", 1, "y0"), at("b", 0, "x1"), at("b", 1, "y1"))
