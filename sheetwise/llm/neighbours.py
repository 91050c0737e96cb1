"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search in it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, small_batches, uniform, whole_groups
from .vectors import matrix

#: Neighbours of a node, starting groupings and the size of their groups. The groups are small, so that the descent does the work.
DEGREE, TREES, LEAF = 48, 8, 64
#: Vectors that the groupings' thresholds are taken from. Every vector is indexed.
SAMPLE = 4096
#: The descent ends with the first round that changes less than this share of the graph.
CHANGE = 0.02
#: Nodes that a search keeps at least, and as many as are asked for. It ends when all of them are open; those are scored exactly.
BEAM = 32

_GRAPH = "node long, ids array<long>, sims array<double>"


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, node; nodes: node, dims, code, vector): one node for equal vectors, none where a vector takes no part.

    code is the vector as the column holds it, in single or double precision; the graph and the search rank by its products.
    """
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, dims, code, body, norm = [], [], [], [], []
            for x in matrix(batch.column("embedding")):
                if x is None:
                    for c in (node, dims, code, body, norm):
                        c.append(None)
                    continue
                raw = x.tobytes()
                node.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
                dims.append(len(x))
                code.append(x.astype(kind).tobytes())
                body.append(raw)
                norm.append(math.sqrt(float(x @ x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(node, pa.int64()), pa.array(dims, pa.int32()), pa.array(code, pa.binary()), pa.array(body, pa.binary()), pa.array(norm, pa.float64())],
                ["vec_id", "node", "dims", "code", "vector", "norm"],
            )

    made = small_batches(vectors).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, node long, dims int, code binary, vector binary, norm double")
    made = cut(made.where("node IS NOT NULL"))
    one = made.groupBy("node").agg(*(F.first(c).alias(c) for c in ("dims", "code", "vector", "norm")), (F.min("vector") != F.max("vector")).alias("clash"))
    one = cut(one)
    if one.where("clash").limit(1).count():
        raise RuntimeError("two different vectors share a 64-bit id")
    return made.select("vec_id", "node"), one.drop("clash")


def _kind(vectors: DataFrame) -> str:
    """The NumPy type that holds the components of the embeddings without loss."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def decode(codes: list[bytes], kind: str) -> np.ndarray:
    """Vectors in double precision: in a group of near copies products differ by less than single precision resolves."""
    return np.frombuffer(b"".join(codes), kind).reshape(len(codes), -1).astype(np.float64)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def best(node: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each node's k best different others: (node, count) of each list, and the flat others and sims, best first."""
    order = np.lexsort((-sim, other, node))
    node, other, sim = node[order], other[order], sim[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
    node, other, sim = node[new], other[new], sim[new]
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    start = np.ones(len(node), bool)
    start[1:] = node[1:] != node[:-1]
    at = np.flatnonzero(start)
    rank = np.arange(len(node)) - np.repeat(at, np.diff(np.append(at, len(node))))
    keep = rank < k
    return node[at], np.minimum(np.diff(np.append(at, len(node))), k), other[keep], sim[keep]


def _start(points: DataFrame, kind: str) -> DataFrame:
    """The first graph: exact neighbours within groups of similar vectors, in several groupings.

    A grouping takes the signs of random projections against sample medians. Inner products become
    angles by one more coordinate that gives all vectors the largest norm. Crowded groups are dealt out by hash.
    """
    n, top, dims = points.agg(F.count("*"), F.max("norm"), F.max("dims")).first()
    if not n:
        return points.sparkSession.createDataFrame([], _GRAPH)
    bits = max(0, round(math.log2(n / LEAF)))
    sample = points.where(F.col("dims") == dims).orderBy(uniform("node", seed="nn"), "node").limit(SAMPLE).select("vector", "norm").collect()  # bounded
    rng = np.random.default_rng(20240317)
    planes = rng.standard_normal((TREES * max(1, bits), dims + 1))

    def lifted(bodies: list[bytes], norms: np.ndarray) -> np.ndarray:
        x = np.frombuffer(b"".join(bodies), np.float64).reshape(len(bodies), -1)
        return np.column_stack([x, np.sqrt(np.maximum(0, top * top - norms * norms))])

    middle = np.median(lifted([bytes(r["vector"]) for r in sample], np.array([r["norm"] for r in sample])) @ planes.T, axis=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("dims").to_numpy()
            for d in np.unique(size).tolist():
                own = batch.filter(pa.array(size == d))
                x = lifted(own.column("vector").to_pylist(), own.column("norm").to_numpy())
                sign = (x @ planes[:, [*range(d), dims]].T > middle).reshape(len(x), TREES, -1)
                leaf = (sign @ (1 << np.arange(sign.shape[2])) if bits else np.zeros((len(x), TREES))).astype(np.int64)
                for t in range(TREES if bits else 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), own.column("dims"), pa.array(leaf[:, t]), own.column("node"), own.column("code")], ["tree", "dims", "leaf", "node", "code"]
                    )

    dealt = points.select("dims", "node", "vector", "norm", "code").mapInArrow(deal, "tree int, dims int, leaf long, node long, code binary")
    place = ["tree", "dims", "leaf"]
    full = cut(dealt.groupBy(*place).count().where(f"count > {2 * LEAF}").select(*(F.col(c).alias(f"_{c}") for c in place), F.ceil(F.col("count") / LEAF).cast("int").alias("parts")))
    few = full.count() <= 50_000
    dealt = dealt.join(F.broadcast(full) if few else full, [F.col(c) == F.col(f"_{c}") for c in place], "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node", "tree"), F.col("parts")), F.lit(0)).cast("int")).select(*place, "salt", "node", "code")

    def exact(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        x = decode(group.column("code").to_pylist(), kind)
        k = min(DEGREE, len(node) - 1)
        ids, sims = np.zeros((len(node), k), np.int64), np.zeros((len(node), k))
        for at in range(0, len(node) if k else 0, 256):
            s = x[at : at + 256] @ x.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            top_k = np.argpartition(-s, k - 1, axis=1)[:, :k]
            ids[at : at + 256], sims[at : at + 256] = node[top_k], np.take_along_axis(s, top_k, 1)
        counts = np.full(len(node), k)
        return pa.table({"node": node, "ids": _lists(ids.ravel(), counts, pa.int64()), "sims": _lists(sims.ravel(), counts, pa.float64())})

    return merge(dealt.groupBy(*place, "salt").applyInArrow(exact, _GRAPH))


def merge(lists: DataFrame, k: int = DEGREE) -> DataFrame:
    """One list for each node: the k best of all its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "node"):
            ids = batch.column("ids")
            node = np.repeat(batch.column("node").to_numpy(), np.diff(ids.offsets.to_numpy()))
            other, sim = ids.flatten().to_numpy(), batch.column("sims").flatten().to_numpy()
            who, counts, other, sim = best(node, other, sim, k)
            yield pa.RecordBatch.from_arrays([pa.array(who), _lists(other, counts, pa.int64()), _lists(sim, counts, pa.float64())], ["node", "ids", "sims"])

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, _GRAPH)


def _descend(graph: DataFrame, codes: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Candidate lists from one round, and a table that they are read from: at each node its neighbours, and as many nodes it is a neighbour of, meet each other.

    A pair is passed on to a member whose worst neighbour it beats. A hub, which is in very many lists, is a popular key of a
    join of two plain tables, which can be split; of the nodes that it is a neighbour of, each task passes on DEGREE at most.
    """
    forward = graph.select(F.col("node").alias("at"), F.explode("ids").alias("node"))
    turn = Window.partitionBy("at").orderBy(F.xxhash64("node", "at"))
    back = forward.select(F.col("node").alias("at"), F.col("at").alias("node")).withColumn("r", F.row_number().over(turn)).where(f"r <= {DEGREE}").select("at", "node")
    worst = graph.select("node", F.when(F.size("ids") >= DEGREE, F.array_min("sims")).otherwise(F.lit(float("-inf"))).alias("worst"))
    state = cut(codes.join(worst, "node"))
    members = forward.union(back).distinct().join(state, "node").select("at", "node", "worst", "code")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "at"):
            at = batch.column("at").to_numpy()
            node, worst_of = batch.column("node").to_numpy(), batch.column("worst").to_numpy()
            codes_of = batch.column("code").to_pylist()
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            a, b, sims = [], [], []
            for lo, hi in zip(begin, np.append(begin[1:], len(at))):
                own = codes_of[lo:hi]
                if len({len(c) for c in own}) != 1:
                    continue
                x = decode(own, kind)
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                i, j = np.nonzero(s > worst_of[lo:hi, None])
                a.append(node[lo + i])
                b.append(node[lo + j])
                sims.append(s[i, j])
            if a:
                who, counts, other, sim = best(np.concatenate(a), np.concatenate(b), np.concatenate(sims), DEGREE)
                yield pa.RecordBatch.from_arrays([pa.array(who), _lists(other, counts, pa.int64()), _lists(sim, counts, pa.float64())], ["node", "ids", "sims"])

    return members.repartition("at").sortWithinPartitions("at").mapInArrow(meet, _GRAPH), state


def build(points: DataFrame, kind: str, watch: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The neighbour graph (node, ids, sims), improved by joins of neighbours of neighbours until little of it changes.

    Lists only get better, so this ends. `watch` is called with the graph before the first round and after each.
    """
    codes = points.select("node", "code")
    graph = cut(_start(points, kind))
    while True:
        if watch:
            watch(graph)
        lists, state = _descend(graph, codes, kind)
        after = cut(merge(graph.union(lists)))
        drop(state)
        old = graph.select(F.col("node").alias("_n"), F.col("ids").alias("old"))
        change = after.join(old, F.col("node") == F.col("_n")).agg(F.sum(F.size(F.array_except("ids", "old"))), F.sum(F.size("ids"))).first()
        drop(graph)
        graph = after
        if not change[1] or change[0] < CHANGE * change[1]:
            if watch:
                watch(graph)
            return graph


def search(starts: DataFrame, graph: DataFrame, codes: DataFrame, form: str, beam: int = BEAM) -> DataFrame:
    """(query, ids, sims): greedy search from each query's own node, `starts` (query, code).

    Each hop opens those of a query's `beam` best nodes that are not open yet and scores their neighbours. The search ends when
    all queries' `beam` best nodes are open; pools, of twice as many, only get better, so it does.
    """
    links = graph.select("node", "ids")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() AS array<{kind}>)")).alias(c)
    pool = cut(starts.join(graph, F.col("query") == F.col("node"), "left").select("query", none("ids", "long"), none("sims", "double"), F.expr("cast(array(query) AS array<long>)").alias("open")))
    while True:
        front = pool.select("query", F.explode(F.array_except(F.slice("ids", 1, beam), "open")).alias("node"))
        seen = front.join(links, "node").select("query", F.explode("ids").alias("node")).distinct().where("query <> node")
        rows = (
            seen.join(codes, "node").select("query", F.lit(1).alias("kind"), "node", "code", *_no_lists())
            .union(starts.select("query", F.lit(0), F.lit(None).cast("long"), "code", *_no_lists()))
            .union(pool.select("query", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("binary"), "ids", "sims", "open"))
        )

        def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole_groups(batches, "query"):
                query = batch.column("query").to_numpy()
                begin = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
                out: tuple[list, ...] = ([], [], [], [])
                for lo, hi in zip(begin, np.append(begin[1:], len(query))):
                    own = batch.slice(lo, hi - lo)
                    kind = own.column("kind").to_numpy()
                    code, ids = own.column("code"), own.column("ids")
                    head = np.flatnonzero(kind == 0)
                    me = next(code[int(i)].as_py() for i in head if code[int(i)].is_valid)
                    old = next(int(i) for i in head if ids[int(i)].is_valid)
                    had, sims = np.array(ids[old].as_py(), np.int64), np.array(own.column("sims")[old].as_py(), np.float64)
                    opened = np.union1d(np.array(own.column("open")[old].as_py(), np.int64), had[:beam])
                    rest = [(n, c) for n, c in zip(own.column("node").to_pylist(), code.to_pylist()) if n is not None and len(c) == len(me)]
                    node = np.array([n for n, _ in rest], np.int64)
                    s = decode([c for _, c in rest], form) @ decode([me], form)[0] if rest else np.zeros(0)
                    _, _, node, s = best(np.zeros(len(had) + len(node)), np.append(had, node), np.append(sims, s), 2 * beam)
                    for column, value in zip(out, (int(query[lo]), node, s, opened)):
                        column.append(value)
                lens = lambda c: np.array(list(map(len, c)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), _lists(np.concatenate(out[1]), lens(out[1]), pa.int64()), _lists(np.concatenate(out[2]), lens(out[2]), pa.float64()), _lists(np.concatenate(out[3]), lens(out[3]), pa.int64())],
                    ["query", "ids", "sims", "open"],
                )

        after = cut(rows.repartition("query").sortWithinPartitions("query", "kind").mapInArrow(hop, "query long, ids array<long>, sims array<double>, open array<long>"))
        drop(pool)
        pool = after
        if not pool.where(F.size(F.array_except(F.slice("ids", 1, beam), "open")) > 0).limit(1).count():
            return pool


def _no_lists() -> list:
    return [F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<double>").alias("sims"), F.lit(None).cast("array<long>").alias("open")]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose vec_id is divisible by `every`.

    Nearness is the inner product of the original vectors in double precision; ties go to the smaller
    vec_id. Equal vectors are one node of the graph: of its rows the k + 1 smallest vec_ids can be among
    a query's k nearest. A query's own row is no candidate, its copies are. Vectors that are null, zero or hold null
    or non-finite components take no part; a row with a null vec_id is indexed but ranks last among ties.
    Repeated rows of a vec_id count as one.
    """
    rows, points = nodes(vectors)
    rows = rows.distinct()
    kind = _kind(vectors)
    graph = build(points, kind)
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = queries.select(F.col("node").alias("query")).distinct()
    codes = points.select("node", "code")
    starts = cut(asked.join(codes, F.col("query") == F.col("node")).select("query", "code"))
    beam = max(BEAM, k)
    found = search(starts, graph, codes, kind, beam)
    pairs = found.select("query", F.explode(F.slice("ids", 1, 2 * beam)).alias("node")).union(starts.select("query", F.col("query").alias("node")))
    body = points.select("node", "vector")
    pairs = pairs.join(body, "node").join(body.select(F.col("node").alias("query"), F.col("vector").alias("of")), "query")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [float(np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64)) for a, b in zip(batch.column("vector").to_pylist(), batch.column("of").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score)], ["query", "node", "score"])

    scored = pairs.mapInArrow(dot, "query long, node long, score double")
    order = Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last())
    members = rows.withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}").select("node", "vec_id")
    top = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    shared = scored.join(members, "node").withColumn("r", F.row_number().over(top)).where(f"r <= {k + 1}").select("query", "vec_id", "score")
    mine = shared.join(queries.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")), "query").where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return mine.withColumn("rank", F.row_number().over(last)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
