"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, small_batches, spread_join

BLOCK_DIMS = 8
#: Rows of one side that meet in a call; fuller cells are split.
SIDE = 2048
#: Cell width in radii: wider cells repeat a probe less often.
WIDTH = 3.0
_BITS = 6


def matrix(array: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; None for null, empty, zero or non-finite vectors and for null components."""
    out: list[np.ndarray | None] = []
    for value in array:
        v = value.values if value.is_valid else None
        if v is None or not len(v) or v.null_count:
            out.append(None)
            continue
        x = v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        with np.errstate(over="ignore"):
            norm = math.sqrt(float(x @ x)) if np.isfinite(x).all() else 0.0
        out.append(x if norm > 0 and math.isfinite(norm) else None)
    return out


def precision(vectors: DataFrame) -> type:
    """What holds the components without loss: 32 bits where the column has no more."""
    return np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, cid, mark, dims and vector (bytes of the column's precision): rows with equal labels and vectors share cid; null where a row links with nothing."""
    kind = precision(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, mark, dims, body = [], [], [], []
            for x, label in zip(matrix(batch.column("embedding")), batch.column("label").to_pylist()):
                if x is None or label is None:
                    cid.append(None), mark.append(None), dims.append(None), body.append(None)
                    continue
                raw = x.astype(kind).tobytes()
                d = hashlib.blake2b(raw, digest_size=16, salt=hashlib.blake2b(str(label).encode(), digest_size=16).digest()).digest()
                cid.append(int.from_bytes(d[:8], "little", signed=True))
                mark.append(int.from_bytes(d[8:], "little", signed=True))
                dims.append(len(x))
                body.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(cid, pa.int64()), pa.array(mark, pa.int64()), pa.array(dims, pa.int32()), pa.array(body, pa.binary())],
                ["vec_id", "label", "cid", "mark", "dims", "vector"],
            )

    return small_batches(vectors).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(
        run, "vec_id long, label long, cid long, mark long, dims int, vector binary"
    )


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix, so that a block's share of a distance is even."""
    q, r = np.linalg.qr(np.random.default_rng(20240301 + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def budgets(dims: int, cosine: float) -> list[float]:
    """Squared distance that each block may take: its share of 2 - 2 * cosine, plus a little for rounding."""
    return [(2 - 2 * cosine) * (b - a) / dims * (1 + 1e-9) + 1e-12 for a, b in blocks(dims)]


def _cells(x: np.ndarray, radius: float, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell key): the home cell of each row, or every cell its ball touches."""
    width, slack = WIDTH * radius, radius * 1e-6
    row, key = np.arange(len(x)), np.zeros(len(x), np.int64)
    for d in range(x.shape[1]):
        lo = np.floor((x[row, d] - (radius + slack if probe else 0)) / width).astype(np.int64)
        hi = np.floor((x[row, d] + (radius + slack if probe else 0)) / width).astype(np.int64)
        span = hi - lo + 1
        rep = np.repeat(np.arange(len(row)), span)
        cell = lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(span) - span, span)
        row, key = row[rep], (key[rep] << _BITS) + (cell + (1 << (_BITS - 1)))
    return row, key


def _unit(bodies: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(bodies), kind).astype(np.float64).reshape(len(bodies), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row; links need equal labels and cosine at least.

    Unit vectors that close have a squared distance of 2 - 2 * cosine at most, so in one block of the
    rotated vector at least it stays within the block's share. Each block is range-joined on a grid;
    what meets within the share is verified in double precision and counted in the
    first such block only, so a link counts once. Groups return counts and a spanning forest, not
    pairs: what leaves them is linear in their rows. Equal vectors are one weighted class. Crowded cells are split on both
    sides. Vectors of different length never link; null labels, and vectors that are null, zero or
    hold null or non-finite components, link with nothing. Repeated rows are separate vectors.
    """
    kind = precision(vectors)
    rows = cut(keyed(vectors))
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("vector").alias("vector"), (F.min("mark") != F.max("mark")).alias("clash")
    )
    classes = cut(classes)
    if classes.where("clash").limit(1).count():
        raise RuntimeError("two different vectors share a 64-bit id")
    most = classes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 1
    grid = max(1, min(BLOCK_DIMS, math.ceil(math.log(max(1.0, most / SIDE * 2), 3))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                dims = part.column("dims").to_numpy()
                for d in np.unique(dims).tolist():
                    own = part.filter(pa.array(dims == d))
                    x = _unit(own.column("vector").to_pylist(), kind) @ rotation(d)
                    for b, ((lo, hi), share) in enumerate(zip(blocks(d), budgets(d, cosine))):
                        for probe in (False, True):
                            row, key = _cells(x[:, lo : min(hi, lo + grid)], math.sqrt(share), probe)
                            got = own.take(pa.array(row))
                            n = len(row)
                            yield pa.RecordBatch.from_arrays(
                                [got.column("label"), got.column("dims"), pa.array(np.full(n, b, np.int32)), pa.array(key), pa.array(np.full(n, probe)), got.column("cid"), got.column("weight"), got.column("vector")],
                                ["label", "dims", "block", "cell", "probe", "cid", "weight", "vector"],
                            )

    dealt = classes.select("cid", "weight", "label", "dims", "vector").mapInArrow(deal, "label long, dims int, block int, cell long, probe boolean, cid long, weight long, vector binary")
    cell = ["label", "dims", "block", "cell"]
    tally = dealt.groupBy(*cell).agg(F.count(F.when(~F.col("probe"), 1)).alias("homes"), F.count(F.when(F.col("probe"), 1)).alias("probes"))
    full = cut(tally.where(f"homes > {SIDE} OR probes > {SIDE}").select(*(F.col(c).alias(f"_{c}") for c in cell), F.ceil(F.col("homes") / SIDE).cast("int").alias("hs"), F.ceil(F.col("probes") / SIDE).cast("int").alias("ps")))
    if full.limit(1).count():
        side = F.broadcast(full) if full.count() <= 50_000 else full
        dealt = dealt.join(side, [F.col(c) == F.col(f"_{c}") for c in cell], "left")
        own = lambda n: F.pmod(F.xxhash64("cid", "block"), F.coalesce(F.greatest(n, F.lit(1)), F.lit(1))).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.coalesce(F.greatest(n, F.lit(1)), F.lit(1)) - 1)
        dealt = dealt.withColumn("h", F.explode(F.when(F.col("probe"), every(F.col("hs"))).otherwise(F.array(own(F.col("hs"))))))
        dealt = dealt.withColumn("p", F.explode(F.when(F.col("probe"), F.array(own(F.col("ps")))).otherwise(every(F.col("ps")))))
    else:
        dealt = dealt.withColumns({"h": F.lit(0), "p": F.lit(0)})

    def meet(group: pa.Table) -> pa.Table:
        probe = group.column("probe").to_numpy(zero_copy_only=False)
        nothing = pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if probe.all() or not probe.any():
            return nothing
        cid, weight = group.column("cid").to_numpy(), group.column("weight").to_numpy()
        x = _unit(group.column("vector").to_pylist(), kind)
        d, block = x.shape[1], group.column("block")[0].as_py()
        turned = x @ rotation(d)
        share = budgets(d, cosine)
        lo, hi = blocks(d)[block]
        homes, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
        near = turned[:, lo:hi]
        square = np.einsum("ij,ij->i", near, near)
        links, found = np.zeros(len(cid), np.int64), []
        for at in range(0, len(homes), 256):
            h = homes[at : at + 256]
            close = square[h][:, None] + square[probes][None, :] - 2 * near[h] @ near[probes].T <= share[block] + 1e-9
            i, j = np.nonzero(close)
            i, j = h[i], probes[j]
            keep = cid[i] < cid[j]
            i, j = i[keep], j[keep]
            for s in range(0, len(i), 1 << 15):
                a, b = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                hit = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[hit], b[hit]
                if len(a):
                    gap = (turned[a] - turned[b]) ** 2
                    inside = np.stack([gap[:, u:v].sum(1) <= share[k] for k, (u, v) in enumerate(blocks(d)[: block + 1])])
                    first = inside[block] & ~inside[:block].any(0)
                    a, b = a[first], b[first]
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    found.append((a, b))
        if not found:
            return nothing
        a, b = (np.concatenate(s) for s in zip(*found))
        low = np.arange(len(cid))
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[new]
            if (new == low).all():
                break
            low = new
        some, tree = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(cid)))
        return pa.table(
            {
                "cid": np.concatenate([cid[some], cid[tree]]),
                "links": np.concatenate([links[some], np.zeros(len(tree), np.int64)]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cid[low[tree]], pa.int64())]),
            }
        )

    found = cut(dealt.groupBy(*cell, "h", "p").applyInArrow(meet, "cid long, links long, other long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    each = classes.select("cid", "weight", "least").join(counts, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    each = cut(each.select("cid", "weight", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("comp")))
    whole = cut(each.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    facts = cut(spread_join(each, whole, "comp", "classes", classes.count()).select("cid", "weight", "n_links", "component_id"))
    drop(classes, full, found, each, whole)
    out = spread_join(rows.select("vec_id", "cid"), facts, "cid", "weight", rows.count())
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
