"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two sets with a Jaccard similarity of 3/4 share at least T = ceil(3n/4) of either's n shingles. In
DivideSkip, a set's T - 1 longest inverted lists are left out and only the n - T + 1 shortest are merged:
whatever reaches T occurs in one of those at least. Here the short lists are built by a shuffle on the
shingle, over all documents, and say which sets can meet. A set then gets the lists of its shingles over
all sets that it meets: short ones are heap-merged, long ones probed by binary search, and the number of
occurrences decides.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, components, cut, drop, pieces, small_batches, spread_join, text_buffer

WORDS = 5
#: 3/4 as integers: two sets link when NUM * union <= DEN * intersection.
NUM, DEN = 3, 4
#: Counters of the frequency sketch, a fixed size at any input: 2 ** 20 in blocks of 4096.
SKETCH_BITS, SKETCH_BLOCK = 20, 4096
#: Lists with more than 2 ** HOT documents are split by salt.
HOT = 16
#: Shingles of the candidates that one call searches.
BUNDLE = 1 << 18
#: Links tried per document in a round before whole lists are compared, and rounds at most. Neither changes the result.
PIVOTS, ROUNDS = 3, 5
#: Star rounds that group the sets linked so far before the next round; the last grouping is whole.
STARS = 2
#: Members of a list that meet in one piece of a join; longer lists are dealt out in blocks.
BLOCK = 1024
#: Distinct sets that a task remembers to list copies once; then it starts anew.
REMEMBERED = 1 << 20

_rng = np.random.default_rng(5_2024)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95


#: Powers that a worker keeps.
KEPT = 3 << 20


class _Powers:
    power = inverse = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        """Powers for texts up to n bytes; those of an unusually long one go with the next shorter."""
        if len(cls.power) > KEPT >= n or len(cls.power) < n:
            for name, x in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; A-Z fold to lower case, null is empty.

    With one to four words the whole sequence is the only shingle.
    """
    raw, offsets = text_buffer(texts)
    n = len(offsets) - 1
    if not len(raw):
        return [np.zeros(0, np.uint64)] * n
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begin = np.zeros(len(raw) + 1, bool)
    begin[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begin[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    _Powers.upto(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _Powers.power[: len(raw)], out=sums[1:])
    word = mix((sums[b] - sums[a]) * _Powers.inverse[a] + (b - a).astype(np.uint64))
    first = np.searchsorted(a, offsets)
    count = np.diff(first)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    m = len(word)
    gram = np.zeros(m, np.uint64)
    for k in range(WORDS):
        gram += padded[k : k + m] * _PLACE[k]
    gram = mix(gram)
    out = []
    for at, c in zip(first[:-1].tolist(), count.tolist()):
        if c >= WORDS:
            out.append(np.unique(gram[at : at + c - WORDS + 1]))
        elif c:
            few = (word[at : at + c] * _PLACE[:c]).sum(dtype=np.uint64) + np.uint64(c)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(own: np.ndarray) -> tuple[int, int]:
    """A set's id and a second number that tells two sets with one id apart."""
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(own: np.ndarray) -> list[int]:
    """A parity bit for each residue of the hashes, two to four bits a shingle in small sets and one to two in large ones, as 64-bit words.

    Two sets differ in as many shingles as their bitmaps in bits, at least. A bitmap of twice the length
    folds to the shorter one.
    """
    bits = 64
    while bits < max(len(own), min(2 * len(own), 512)):
        bits *= 2
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _may_link() -> str:
    """SQL: sizes n_a and n_b fit, and bitmaps m_a and m_b do not differ in more shingles than a link allows."""
    fold = "zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y)"
    a = f"IF(size(m_a) = 2 * size(m_b), {fold.format('m_a', 'm_b')}, m_a)"
    b = f"IF(size(m_b) = 2 * size(m_a), {fold.format('m_b', 'm_a')}, m_b)"
    apart = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return f"{_FIT} AND {apart} <= n_a + n_b - 2 * ceil({NUM} * (n_a + n_b) / {NUM + DEN})"


#: SQL: the largest partner of a set with n shingles if a list at this rank of its common order is the first that both share:
#: what follows must hold enough for a link, (NUM + DEN) * (n - rank) >= NUM * (n + partner).
_REACH = f"(({NUM + DEN} * (n - rank) - {NUM} * n) div {NUM})"
_FIT = f"{NUM} * greatest(n_a, n_b) <= {DEN} * least(n_a, n_b)"


def _survey(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, cid, mark, n, map), and each task's counters of the frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SKETCH_BITS, np.uint32)
        shift = np.uint64(64 - SKETCH_BITS)
        schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("map", pa.list_(pa.int64())), ("block", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"))
                ids = [class_of(s) for s in sets]
                if sets:
                    slots, times = np.unique(np.concatenate(sets) >> shift, return_counts=True)
                    seen[slots.astype(np.int64)] += times.astype(np.uint32)
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([c for c, _ in ids], pa.int64()), pa.array([m for _, m in ids], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(bitmap, sets)), pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                    schema=schema,
                )
        blocks = seen.reshape(-1, SKETCH_BLOCK)
        some = np.flatnonzero(blocks.any(1))
        z = zstandard.ZstdCompressor(level=1)
        k = len(some)
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.list_(pa.int64())), pa.array(some, pa.int32()), pa.array([z.compress(blocks[i].tobytes()) for i in some], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, cid long, mark long, n long, map array<long>, block int, counts binary")


def _frequency_classes(surveyed: DataFrame) -> bytes:
    """A byte for each counter: 0 for what is not clearly above the mean, else the binary logarithm of the excess."""

    def total(group: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        acc = np.zeros(SKETCH_BLOCK, np.uint64)
        for c in group.column("counts").to_pylist():
            acc += np.frombuffer(z.decompress(c), np.uint32)
        return pa.table({"block": group.column("block")[:1], "counts": pa.array([acc.tobytes()], pa.binary())})

    blocks = surveyed.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(total, "block int, counts binary")
    counts = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.float64).reshape(-1, SKETCH_BLOCK)
    for r in blocks.collect():  # 256 rows at most
        counts[r["block"]] = np.frombuffer(r["counts"], np.uint64)
    counts = counts.ravel()
    mean = np.median(counts)
    excess = counts - mean
    classes = np.where(excess > 8 + 5 * math.sqrt(mean), np.floor(np.log2(np.maximum(excess, 1))), 0)
    return classes.astype(np.uint8).tobytes()


def _short_lists(docs: DataFrame, classes: bytes) -> DataFrame:
    """(shingle, cid, rank, pivot): the short lists with two different sets at least, each with a random member as pivot.

    The order of lists, by frequency class and then hash, is the same for all sets. Copies in a task
    are listed once. Lists stream by in sorted order, so none is held in memory, and very long ones are
    dealt out by salt.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(classes, np.uint8)
        shift = np.uint64(64 - SKETCH_BITS)
        done: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                keys, cids = [], []
                for s in shingle_sets(part.column("text")):
                    n = len(s)
                    if not n:
                        continue
                    cid = class_of(s)[0]
                    if cid in done:
                        continue
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(cid)
                    short = n - -(-NUM * n // DEN) + 1
                    often = level[(s >> shift).astype(np.int64)]
                    keys.append(s[np.lexsort((s, often))[:short]] if often.any() else s[:short])
                    cids.append((cid, short))
                if not keys:
                    continue
                key = np.concatenate(keys)
                counts = np.array([k for _, k in cids])
                cid = np.repeat(np.array([c for c, _ in cids], np.int64), counts)
                rank = (np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
                up = np.maximum(level[(key >> shift).astype(np.int64)].astype(np.int64) - HOT, 0)
                salt = np.where(up > 0, (mix(cid.view(np.uint64)) % (np.uint64(1) << up.astype(np.uint64))).astype(np.int64), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(cid), pa.array(rank)], ["shingle", "salt", "cid", "rank"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last member of the list that may go on, and whether it is out
        for batch in batches:
            key, salt, cid, rank = (batch.column(c).to_numpy() for c in ("shingle", "salt", "cid", "rank"))
            out = np.zeros(len(key), bool)
            if held:
                key, salt, cid, rank, out = (np.append(h, c) for h, c in zip(held, (key, salt, cid, rank, out)))
            if not len(key):
                continue
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            new = np.append(True, ~(same & (cid[1:] == cid[:-1])))
            key, salt, cid, rank, out = key[new], salt[new], cid[new], rank[new], out[new]
            begin = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
            size = np.bincount(np.cumsum(begin) - 1)
            shared = (size > 1)[np.cumsum(begin) - 1] | (salt >= 0)
            show = shared & ~out
            held = (key[-1], salt[-1], cid[-1], rank[-1], shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[show]), pa.array(cid[show]), pa.array(rank[show])], ["shingle", "cid", "rank"])

    rows = docs.select("text").where("text IS NOT NULL").mapInArrow(emit, "shingle long, salt int, cid long, rank int")
    return rows.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "cid").mapInArrow(lists, "shingle long, cid long, rank int")


def _different(lists: DataFrame) -> DataFrame:
    """(shingle, cid, rank, times): of lists with the same members only the first in the common order, and how many they are.

    A passage makes as many equal lists as it has shingles. A pair that is in all of them shares that first one before the
    others. Member sets are told apart by their number and 128 bits of combined hashes.
    """
    marks = [F.expr(f"bit_xor(xxhash64(cid, {k}L))").alias(f"m{k}") for k in (1, 2)]
    each = lists.groupBy("shingle").agg(F.count("*").alias("k"), *marks, F.min("rank").alias("at")).where("k > 1")
    first = each.groupBy("k", "m1", "m2").agg(F.min_by("shingle", F.struct("at", "shingle")).alias("shingle"), F.count("*").alias("times"))
    return lists.join(first.select(F.col("shingle").alias("_s"), "times", F.col("k").alias("members")), F.col("shingle") == F.col("_s")).drop("_s")


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which sets link with the query.

    Inverted lists of the query's shingles over the sets, sorted by length; the short ones are
    heap-merged, and a set that occurs in enough of them is looked up in the long ones by binary search.
    """
    n = len(query)
    need = [-(-NUM * (n + len(s)) // (NUM + DEN)) for s in sets]
    fits = [i for i, s in enumerate(sets) if NUM * max(n, len(s)) <= DEN * min(n, len(s))]
    if not fits:
        return []
    least = min(need[i] for i in fits)
    shingle, owner = np.concatenate([sets[i] for i in fits]), np.repeat(fits, [len(sets[i]) for i in fits])
    order = np.lexsort((owner, shingle))
    shingle, owner = shingle[order], owner[order]
    begin, end = np.searchsorted(shingle, query, "left"), np.searchsorted(shingle, query, "right")
    inverted = sorted((owner[a:b].tolist() for a, b in zip(begin.tolist(), end.tolist()) if b > a), key=len)
    longest = len(inverted[-1]) if inverted else 0
    n_long = min(least - 1, int(least / (0.01 * math.log2(max(2, longest)) + 1)), len(inverted))
    short, long = inverted[: len(inverted) - n_long], inverted[len(inverted) - n_long :]
    found = []
    for i, times in groupby(heapq.merge(*short)):
        c = sum(1 for _ in times)
        if c < need[i] - n_long:
            continue
        for k, x in enumerate(long):
            at = bisect_left(x, i)
            c += at < len(x) and x[at] == i
            if c + len(long) - k - 1 < need[i]:
                break
        if c >= need[i]:
            found.append(i)
    return found


def _check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. pairs: (a, b, n_a); texts: (cid, body). A set's lists are searched over a bundle of partners at a time."""
    tally = pairs.groupBy("a").agg((F.count("*") * F.first("n_a")).alias("k")).withColumnRenamed("a", "_a")
    dealt = pairs.join(tally, F.col("a") == F.col("_a")).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / BUNDLE)).cast("int")).select("a", "b", "salt")
    rows = dealt.select("a", "salt", F.col("b").alias("cid")).union(dealt.select("a", "salt", F.col("a").alias("cid")).distinct())
    rows = rows.join(texts, "cid").select("a", "salt", "cid", "body")

    def search(group: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        a = group.column("a")[0].as_py()
        cid = group.column("cid").to_pylist()
        bodies = pa.array([z.decompress(x) for x in group.column("body").to_pylist()], pa.binary())
        sets = shingle_sets(bodies.cast(pa.string()))
        at = cid.index(a)
        found = [cid[i] for i in divide_skip(sets[at], sets) if i != at]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows.groupBy("a", "salt").applyInArrow(search, "a long, b long")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, body) of one document of each wanted set: the text in zstandard, smaller than its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        done: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                cids, bodies = [], []
                for s, t in zip(shingle_sets(part.column("text")), part.column("text").cast(pa.binary())):
                    if len(s) and (cid := class_of(s)[0]) not in done:
                        if len(done) >= REMEMBERED:
                            done.clear()
                        done.add(cid)
                        cids.append(cid)
                        bodies.append(z.compress(t.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(bodies, pa.binary())], ["cid", "body"])

    made = docs.select("text").where("text IS NOT NULL").mapInArrow(run, "cid long, body binary")
    one = Window.partitionBy("cid").orderBy(F.length("body"), "body")
    return made.join(wanted, "cid", "left_semi").withColumn("r", F.row_number().over(one)).where("r = 1").select("cid", "body")


def _try(lists: DataFrame, parts: DataFrame | None, known: DataFrame, done: DataFrame | None, turn: int) -> DataFrame:
    """(a, b, n_a): for each set b a few pivots a of lists that it is in, each from another component.

    Before there are components, a list's pivot is the member with the longest lists: the middle of a group of near copies shares
    most, and links also with members that do not link with each other. Later it is some member of the component that most of
    the list's members are in, so members outside it are few. A list without two members of one component is not tried again:
    no try has linked two of its members, as where they share a passage only, and _rest compares them. The pairs in `done` have
    been compared. known: (cid, n, map). Written step by step, as Spark plans all that is left anew after each stage.
    """
    if parts is None:
        held = lists.groupBy(F.col("cid").alias("_c")).agg(F.sum("members").alias("weight"))
        here = lists.join(held, F.col("cid") == F.col("_c")).select("shingle", "cid", "times", F.col("cid").alias("comp"), "weight")
    else:
        here = cut(_open(lists, parts).select("shingle", "cid", "times", "comp", F.lit(0).alias("weight")))  # read three times below
    each = here.groupBy("shingle", "comp").agg(F.count("*").alias("k"), F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("a"), F.max("weight").alias("weight"))
    pivot = each.groupBy("shingle").agg(F.max_by(F.struct("a", "comp", "k"), F.struct("k", "weight", F.xxhash64("a", F.lit(turn)))).alias("p"))
    if parts is not None:
        pivot = pivot.where("p.k > 1")
    pivot = pivot.select(F.col("shingle").alias("_s"), "p.a", F.col("p.comp").alias("of"))
    seen = here.join(pivot, F.col("shingle") == F.col("_s")).where("comp <> of").groupBy("a", F.col("cid").alias("b")).agg(F.sum("times").alias("times"))
    if done is not None:
        seen = seen.join(done, ["a", "b"], "left_anti")
    best = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    some = cut(seen.withColumn("r", F.row_number().over(best)).where(f"r <= {3 * PIVOTS}").drop("r"))
    sized = _sized(some, known).where(F.expr(_may_link()))
    tried = cut(sized.withColumn("r", F.row_number().over(best)).where(f"r <= {PIVOTS}").select("a", "b", "n_a"))
    drop(some, here)
    return tried


def _sized(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sets' sizes and bitmaps."""
    for x in "ab":
        pairs = pairs.join(known.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("map").alias(f"m_{x}")), x)
    return pairs


def _open(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The lists whose members are not yet in one component, with each member's component as comp."""
    comp = lists.join(parts.select(F.col("node").alias("_n"), "component"), F.col("cid") == F.col("_n"), "left").drop("_n")
    comp = comp.withColumn("comp", F.coalesce("component", "cid")).drop("component")
    mixed = comp.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("shingle").alias("_s"))
    return comp.join(mixed, F.col("shingle") == F.col("_s")).drop("_s")


def _rest(lists: DataFrame, parts: DataFrame, known: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b, n_a): all pairs of open lists from two components that may link and are not in `done`.

    Sizes, ranks and parity bitmaps rule out, without loss, what cannot link, before a pair leaves the join. Long lists
    are dealt out: a member is in one block on one side and meets all blocks' members of the other.
    """
    opened = cut(_open(lists, parts))
    rows = opened.join(known.select("cid", "n"), "cid").withColumn("reach", F.expr(_REACH)).select("shingle", "cid", "comp", "n", "reach", "members")
    span = rows.groupBy("shingle").agg(F.min("n").alias("least"), F.max("reach").alias("most")).withColumnRenamed("shingle", "_s")
    rows = rows.join(span, F.col("shingle") == F.col("_s")).where("reach >= least AND n <= most").drop("_s", "least", "most")
    rows = cut(rows.join(known.select("cid", "map"), "cid"))  # bitmaps come last, as they are the widest column
    drop(opened)
    side = lambda x: [F.col(c).alias(f"{t}_{x}") for c, t in (("comp", "c"), ("n", "n"), ("reach", "r"), ("map", "m"))]
    fits = F.expr(f"c_a < c_b AND n_b <= r_a AND n_a <= r_b AND {_may_link()}")
    few, many = rows.where(f"members <= {BLOCK}"), rows.where(f"members > {BLOCK}").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    met = few.select("shingle", F.col("cid").alias("a"), *side("a")).join(few.select("shingle", F.col("cid").alias("b"), *side("b")), "shingle").where(fits)
    left = many.select("shingle", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), F.col("cid").alias("a"), *side("a"))
    right = many.select("shingle", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("cid").alias("b"), *side("b"))
    met = met.select("a", "b", "n_a").union(left.join(right, ["shingle", "block"]).where(fits).select("a", "b", "n_a"))
    return met.groupBy("a", "b").agg(F.first("n_a").alias("n_a")).join(done, ["a", "b"], "left_anti")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row.

    Equal sets are one class. Each class is first compared with a few pivots of the lists that it is
    in, in rounds as long as they find links, which joins groups of near copies around their middles; then, in lists whose members are not yet in
    one component, all members of different components are compared, where it can be the first list that two linked sets
    share: nothing before it in the common order is shared, so enough must follow. A pair inside a component needs no
    comparison, so a group of near copies costs as many comparisons as it has members, and no link between
    components is missed. Null and empty texts have no shingles and link with nothing; rows with a repeated doc_id share
    a result if their sets are linked. Other columns are not read. An empty table gives no rows.
    """
    docs = small_batches(docs).select("doc_id", "text")
    surveyed = cut(_survey(docs))
    owned = surveyed.where("block IS NULL")
    classes = _frequency_classes(surveyed)
    whole = cut(_short_lists(docs, classes))
    lists = cut(_different(whole))
    drop(whole)
    known = owned.where("n > 0").groupBy("cid").agg(F.min("n").alias("n"), F.first("map").alias("map"), (F.min("mark") != F.max("mark")).alias("clash"))
    known = cut(known.join(lists.select("cid").distinct(), "cid", "left_semi"))
    if known.where("clash").limit(1).count():
        raise RuntimeError("two different shingle sets share a 64-bit id")
    known = known.drop("clash")
    bodies = bucketed(_bodies(docs, known.select("cid")), "cid")

    links, tried, parts, first = [], [], None, 0
    for turn in range(ROUNDS):
        done = _both_ways(_all(tried)) if tried else None
        tried.append(_try(lists, parts, known, done, turn))
        links.append(cut(_check(tried[-1], bodies)))
        found = links[-1].count()
        first = first or found
        if parts is None or found:
            parts = cut(components(_all(links), rounds=STARS))  # equal labels are linked sets, which is all that the next round needs
        if found <= first // 100:
            break
    parts = cut(components(_all(links)))  # whole, as every pair that two labels of one group leave apart would meet below
    more = cut(_rest(lists, parts, known, _both_ways(_all(tried))))
    last = cut(_check(more, bodies))
    parts = cut(components(_all([parts.select(F.col("component").alias("a"), F.col("node").alias("b")), last])))
    drop(bodies, lists, known, more, last, *tried, *links)
    member = owned.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
    each = member.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least"))
    each = each.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    each = cut(each)
    whole = cut(each.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    facts = cut(spread_join(each, whole, "comp", "classes", each.count()).select("cid", "docs", "component_id"))
    drop(each, whole)
    out = spread_join(member, facts, "cid", "docs", member.count())
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)
