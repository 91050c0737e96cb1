"""Range joins, ordered folds, recursion and text patterns on the driver's tables, through the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.functions import numbers, text
from sheetwise.operators import bands, binding, closure, numbering, overlap, units
from sheetwise.session import table

from .registry import declare, register

_SPAN = "epoch_us(ts) / 60000000.0::DOUBLE AS lo, epoch_us(ts) / 60000000.0::DOUBLE + value AS hi"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intervals in minutes."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 60000000.0
    return table(spark, sf_dir, "events").where("value > 0").select("event_id", "user_id", "event_type", start.alias("lo"), (start + F.col("value")).alias("hi"))


def _sided(spans: DataFrame, side: str, on: list[str]) -> DataFrame:
    return spans.select(*on, *(F.col(c).alias(f"{c}_{side}") for c in spans.columns if c not in on))


@register(
    "interval_overlap",
    f"""WITH s AS (SELECT event_id, user_id, {_SPAN} FROM events WHERE value > 0)
        SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id
          AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.00001::DOUBLE""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir).drop("event_type")
    pairs = overlap.range_join(_sided(s, "a", ["user_id"]), _sided(s, "b", ["user_id"]), ["user_id"], ("lo_a", "hi_a"), ("lo_b", "hi_b"))
    return pairs.where("event_id_a < event_id_b").select("user_id", F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"))


@register(
    "overlap_one_vs_all",
    f"""WITH s AS (SELECT event_id, user_id, event_type, {_SPAN} FROM events WHERE value > 0)
        SELECT a.event_id, count(*) AS hits FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id <> b.event_id
          AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.00001::DOUBLE WHERE a.event_type = 'purchase' GROUP BY a.event_id""",
)
def overlap_one_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir)
    pairs = overlap.range_join(_sided(s.where("event_type = 'purchase'"), "a", ["user_id"]), _sided(s, "b", ["user_id"]), ["user_id"], ("lo_a", "hi_a"), ("lo_b", "hi_b"))
    return pairs.where("event_id_a <> event_id_b").groupBy(F.col("event_id_a").alias("event_id")).agg(F.count("*").alias("hits"))


@register(
    "overlap_by_root",
    f"""WITH s AS (SELECT event_id, user_id, event_type, {_SPAN} FROM events WHERE value > 0)
        SELECT a.event_type AS root, a.user_id, count(*) AS pairs FROM s a JOIN s b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.event_id < b.event_id
          AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.00001::DOUBLE GROUP BY 1, 2""",
)
def overlap_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, on = _spans(spark, sf_dir), ["event_type", "user_id"]
    pairs = overlap.range_join(_sided(s, "a", on), _sided(s, "b", on), on, ("lo_a", "hi_a"), ("lo_b", "hi_b"))
    return pairs.where("event_id_a < event_id_b").groupBy(F.col("event_type").alias("root"), "user_id").agg(F.count("*").alias("pairs"))


_CIRCLES = "SELECT vec_id AS circle, label, embedding[1]::DOUBLE AS cx, embedding[2]::DOUBLE AS cy, (0.02 + (vec_id % 7) * 0.01)::DOUBLE AS r FROM embeddings"


@register(
    "nearest_enclosing",
    f"""WITH c AS ({_CIRCLES}), p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
        SELECT p.vec_id, arg_min(circle, (r, circle)) AS circle FROM p JOIN c ON p.label = c.label AND p.x >= c.cx - c.r AND p.x <= c.cx + c.r
          AND (p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) <= c.r * c.r AND p.vec_id <> c.circle GROUP BY p.vec_id""",
)
def nearest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest circle of any other row around each point: the binding of labels to circles, on the first two components."""
    xy = [F.get("embedding", F.lit(i)).cast("double") for i in (0, 1)]
    v = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    points = v.select("label", "vec_id", xy[0].alias("x"), xy[1].alias("y"))
    rings = v.select("label", F.col("vec_id").alias("circle"), xy[0].alias("cx"), xy[1].alias("cy"), F.expr("cast(0.02 + (vec_id % 7) * 0.01 AS double)").alias("r"))
    return binding.smallest_enclosing(points, rings, ["label"], "vec_id").select("vec_id", "circle")


@register(
    "box_contained",
    """SELECT p_partkey, (p_size >= 10 - 0.00001::DOUBLE AND p_retailprice >= 950 - 0.00001::DOUBLE AND p_size + 5 <= 40 + 0.00001::DOUBLE AND p_retailprice + 20 <= 1600 + 0.00001::DOUBLE) AS inside FROM part""",
)
def box_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    box = F.array(d("p_size"), d("p_retailprice"), d("p_size") + 5, d("p_retailprice") + 20)
    return table(spark, sf_dir, "part").select("p_partkey", overlap.contained(box, F.array(*(F.lit(float(x)) for x in (10, 950, 40, 1600)))).alias("inside"))


@register(
    "affine_bbox",
    """WITH c AS (SELECT p_brand, 2.0::DOUBLE * x + -1.0::DOUBLE * y + 0.0::DOUBLE * 0 + 10.0::DOUBLE AS u, 0.5::DOUBLE * x + 3.0::DOUBLE * y + 0.0::DOUBLE * 0 + -4.0::DOUBLE AS v
                   FROM (SELECT p_brand, unnest([p_size, p_size, p_size + 5, p_size + 5])::DOUBLE AS x, unnest([p_retailprice, p_retailprice + 20, p_retailprice, p_retailprice + 20]) AS y FROM part))
       SELECT p_brand, min(u) AS min_x, min(v) AS min_y, max(u) AS max_x, max(v) AS max_y FROM c GROUP BY p_brand""",
)
def affine_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of each brand's boxes after an affine map of their four corners."""
    m = F.array(*(F.lit(float(x)) for x in (2, -1, 0, 10, 0.5, 3, 0, -4, 0, 0, 1, 0, 0, 0, 0, 1)))
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    corners = F.array(*(F.struct(a.alias("x"), b.alias("y")) for a in (x, x + 5) for b in (y, y + 20)))
    moved = table(spark, sf_dir, "part").select("p_brand", F.explode(corners).alias("c")).select("p_brand", numbers.transform_point(m, F.col("c.x"), F.col("c.y"), F.lit(0.0)).alias("q"))
    u, v = F.element_at("q", 1), F.element_at("q", 2)
    return moved.groupBy("p_brand").agg(F.min(u).alias("min_x"), F.min(v).alias("min_y"), F.max(u).alias("max_x"), F.max(v).alias("max_y"))


_SEGMENTS = """SELECT user_id, event_id, x0, y0, x1, y1 FROM (SELECT user_id, event_id, (event_id % 100)::DOUBLE AS x0, value AS y0,
                 lead((event_id % 100)::DOUBLE) OVER w AS x1, lead(value) OVER w AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x1 IS NOT NULL"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 100).cast("double").alias("x0"), F.col("value").alias("y0"))
    return at.withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w)}).where("x1 IS NOT NULL").drop("ts")


@register("pairwise_segments", _SEGMENTS)
def pairwise_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's consecutive points as segments, as a polyline's vertices give them."""
    return _segments(spark, sf_dir)


@register(
    "segment_classify",
    f"""SELECT event_id, 'vertical' AS kind, (x0 + x1) / 2 AS at, least(y0, y1) AS lo, greatest(y0, y1) AS hi FROM ({_SEGMENTS}) WHERE abs(y1 - y0) > 0 AND abs(x1 - x0) <= 0.01::DOUBLE * abs(y1 - y0)
        UNION ALL SELECT event_id, 'horizontal', (y0 + y1) / 2, least(x0, x1), greatest(x0, x1) FROM ({_SEGMENTS}) WHERE abs(x1 - x0) > 0 AND abs(y1 - y0) <= 0.01::DOUBLE * abs(x1 - x0)""",
)
def segment_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.straight(_segments(spark, sf_dir), ["event_id"])


# ---- folds, recursion, numbering ----


@register(
    "anchored_bands",
    """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events),
         f AS (SELECT user_id, r, value AS anchor, 1.0::DOUBLE AS size, 0 AS band FROM o WHERE r = 1
               UNION ALL SELECT f.user_id, o.r, CASE WHEN abs(o.value - f.anchor) <= 0.45::DOUBLE * greatest(1.0::DOUBLE, f.size) THEN f.anchor ELSE o.value END, 1.0::DOUBLE,
                 CASE WHEN abs(o.value - f.anchor) <= 0.45::DOUBLE * greatest(1.0::DOUBLE, f.size) THEN f.band ELSE f.band + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
       SELECT user_id, band, anchor, count(*) AS members FROM f GROUP BY 1, 2, 3""",
)
def anchored_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bands.anchored_bands(table(spark, sf_dir, "events"), ["user_id"], F.col("value"), F.lit(1.0), [F.col("event_id")])
    return out.select("user_id", "band", "anchor", "members")


@register("ordered_ids", "SELECT doc_id, format('unit-{:06d}', row_number() OVER (ORDER BY source NULLS FIRST, doc_id)) AS id FROM documents")
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive ids in the order of source and document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    numbered = numbering.number_rows(docs, [F.col("source").asc_nulls_first(), F.col("doc_id")])
    return numbered.select("doc_id", F.format_string("unit-%06d", "number").alias("id"))


_EDGES = """SELECT 'R' || r_regionkey AS parent, 'N' || n_nationkey AS child, 0.5::DOUBLE AS scale, n_nationkey * 10.0::DOUBLE AS shift FROM region JOIN nation ON n_regionkey = r_regionkey
            UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 0.25::DOUBLE, (c_custkey % 17) * 1.0::DOUBLE FROM customer"""


@register(
    "recursive_closure",
    f"""WITH RECURSIVE e AS ({_EDGES}), p AS (SELECT 'R' || r_regionkey AS owner, 'R' || r_regionkey AS block, 1.0::DOUBLE AS scale, 0.0::DOUBLE AS shift, 0 AS depth FROM region
        UNION ALL SELECT p.owner, e.child, p.scale * e.scale, p.scale * e.shift + p.shift, p.depth + 1 FROM p JOIN e ON e.parent = p.block)
        SELECT owner, block, scale, shift, depth FROM p""",
)
def recursive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as nested blocks with composed transforms."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child"), F.lit(0.5).alias("scale"), (F.col("n_nationkey") * 10.0).alias("shift"))
    edges = edges.union(customer.select(name("N", "c_nationkey"), name("C", "c_custkey"), F.lit(0.25), (F.col("c_custkey") % 17) * 1.0))
    placed = closure.closure(edges, region.select(name("R", "r_regionkey").alias("id")))
    return placed.select("owner", "block", "scale", "shift", "depth")


@register(
    "cycle_guard",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS parent, (n_nationkey * 7 + 3) % 25 AS child FROM nation),
         p AS (SELECT n_nationkey AS owner, n_nationkey AS block, [n_nationkey] AS path, false AS cyclic FROM nation
               UNION ALL SELECT p.owner, e.child, list_append(p.path, e.child), list_contains(p.path, e.child) FROM p JOIN e ON e.parent = p.block WHERE NOT p.cyclic)
       SELECT owner, block AS meets, len(path) - 1 AS steps FROM p WHERE cyclic""",
)
def cycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of references that meet a block twice."""
    nation = table(spark, sf_dir, "nation")
    edges = nation.selectExpr("n_nationkey AS parent", "(n_nationkey * 7 + 3) % 25 AS child", "1.0D AS scale", "0.0D AS shift")
    return closure.endless(edges, nation.selectExpr("n_nationkey AS id"))


# ---- text and numbers ----


@register(
    "id_pattern_filter",
    """SELECT p_partkey, replace(p_brand, '#', '') AS code FROM part WHERE regexp_full_match(replace(p_brand, '#', ''), '[A-Za-z]{0,6}[0-9]{1,5}[A-Za-z]?|[A-Za-z]([-/][A-Za-z0-9]+)+')""",
)
def id_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).where(F.col("code").rlike(text.IDENTIFIER))


declare(
    "char_range_filter",
    r"SELECT doc_id, lang FROM {documents} WHERE text RLIKE '[\\u00e0-\\u00ff]'",
    "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[à-ÿ]')",
)


@register("sanitize_code", "SELECT DISTINCT p_type, upper(regexp_replace(p_type, '[^A-Za-z0-9-]', '', 'g')) AS code FROM part")
def sanitize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_type", text.code_suffix(F.col("p_type")).alias("code")).distinct()


@register(
    "boundary_literal",
    r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS token FROM benchmark),
             -- delimiters are doubled, so that one word's end is not another's missing start
             d AS (SELECT '  ' || regexp_replace(coalesce(text, ''), '([^A-Za-z0-9_.])', '\1\1', 'g') || '  ' AS text FROM documents),
             w AS (SELECT unnest(list_distinct(regexp_extract_all(text, '[^A-Za-z0-9_.]([A-Za-z]{6,})([^A-Za-z0-9_.]|\.[^0-9])', 1))) AS token FROM d)
        SELECT token, count(*) AS documents FROM w JOIN t USING (token) GROUP BY token""",
)
def boundary_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a word of any benchmark item stands as a unit."""
    return _word_documents(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def _word_documents(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, documents): a word is a whole run of letters, so one fixed pattern finds all that stand as units, and an equi-join counts them."""
    words = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("token")
    tokens = items.select(words("[A-Za-z]{6,}")).distinct()
    seen = docs.select(words(r"(?<![A-Za-z0-9_.])[A-Za-z]{6,}+(?=[^A-Za-z0-9_.]|$|\.(?:[^0-9]|$))"))
    return seen.join(tokens, "token").groupBy("token").agg(F.count("*").alias("documents"))


@register(
    "char_balance",
    """SELECT page_id, length(html) - length(replace(html, '<', '')) - (length(html) - length(replace(html, '>', ''))) AS tags,
              length(html) - length(replace(replace(html, '(', ''), '[', '')) - (length(html) - length(replace(replace(html, ')', ''), ']', ''))) AS brackets FROM pages""",
)
def char_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.balance(html, "<", ">").alias("tags"), text.balance(html, "([", ")]").alias("brackets"))



@register(
    "ulp_tolerant_diff",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM (
         SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_extendedprice * (1 + CASE WHEN l_orderkey % 5 = 0 THEN 1e-9::DOUBLE WHEN l_orderkey % 3 = 0 THEN 1e-16::DOUBLE ELSE 0 END) AS b FROM lineitem)
       WHERE a <> b AND abs(a - b) > 1e-10::DOUBLE GROUP BY 1, 2""",
)
def ulp_tolerant_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that differ by more than rounding from a perturbed copy."""
    shift = F.expr("CASE WHEN l_orderkey % 5 = 0 THEN 1e-9D WHEN l_orderkey % 3 = 0 THEN 1e-16D ELSE 0 END")
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + shift)
    return table(spark, sf_dir, "lineitem").where(~numbers.same_number(a, b)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@register("greedy_chain")
def greedy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of events read as fragments: a user is a block, the value a baseline and the time of day a position."""
    e = table(spark, sf_dir, "events")
    x = (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000.0) % 24
    box = F.array(x, F.col("value"), x + 0.5, F.col("value") + 1.0)
    rows = e.select(
        F.col("event_id").cast("int").alias("ordinal"), F.col("user_id").cast("string").alias("block"), F.lit(None).cast("string").alias("region"), F.lit("TEXT").alias("kind"),
        F.col("event_type").alias("raw"), F.lit(None).cast("string").alias("visibleText"), F.lit(1.0).alias("height"), F.lit(0.0).alias("rotation"), box.alias("box"),
        F.array(x, F.col("value")).alias("position"), F.lit(False).alias("generatedByDimension"),
    )
    return units.build_units(rows).select("block", "place", "members", "source", "nlines")
