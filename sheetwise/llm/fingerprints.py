"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

One hash of each five-word shingle serves all bins: its highest bits name the bin, the least hash of a bin is the bin's
value. A bin that got no shingle takes the value of another one, found along a sequence of places that depends on the empty bin alone
and is the same for all documents, so two sets agree in a densified bin as often as in a full one. Four low-order bits
of each value are kept, as one hexadecimal digit; bins of different values agree in them by chance, once in sixteen,
and `likeness` takes that share off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, small_batches
from .jaccard import mix, shingle_sets

BIN_BITS, BITS = 9, 4
BINS = 1 << BIN_BITS
#: The share of bins of different values whose kept bits agree.
CHANCE = 1 / (1 << BITS)
#: Places that all documents of a slice try together; few need more.
TOGETHER = 32
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _place(attempt: int) -> np.ndarray:
    """Where each bin looks at an attempt."""
    return (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


@cache
def _first_attempts() -> np.ndarray:
    """At [b, j] the first attempt at which bin b looks at bin j."""
    out = np.full((BINS, BINS), -1, np.int32)
    rows, attempt = np.arange(BINS), 0
    while (out < 0).any():
        j = _place(attempt)
        new = out[rows, j] < 0
        out[rows[new], j[new]] = attempt
        attempt += 1
    return out


def digits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS numbers below 16 for each set of sorted distinct hashes; a row of an empty set is all zeros."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    low, full = np.zeros(n * BINS, np.uint8), np.zeros(n * BINS, bool)
    if sizes.sum():
        h = np.concatenate(sets)
        at = np.repeat(np.arange(n) * BINS, sizes) + (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        least = np.append(True, at[1:] != at[:-1])  # hashes are sorted, so a bin's first is its least
        low[at[least]] = (h[least] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        full[at[least]] = True
    empty = np.flatnonzero(~full & np.repeat(sizes > 0, BINS))
    for attempt in range(TOGETHER):
        if not len(empty):
            break
        giver = empty - empty % BINS + _place(attempt)[empty % BINS]
        hit = full[giver]
        low[empty[hit]] = low[giver[hit]]
        empty = empty[~hit]
    doc = empty // BINS
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
    for some in np.split(empty, starts[1:]) if len(doc) else []:
        base = some[0] - some[0] % BINS
        there = np.flatnonzero(full[base : base + BINS])
        low[some] = low[base + there[_first_attempts()[(some - base)[:, None], there].argmin(1)]]
    return low.reshape(n, BINS)


def packed(row: np.ndarray, size: int) -> str:
    """The fingerprint: a digit for each bin, or the empty string for the empty set."""
    return _DIGITS[row].tobytes().decode() if size else ""


def alike(a: str, b: str) -> float:
    """The estimated Jaccard similarity of two fingerprints: 1 for equal ones, 0 if only one is empty."""
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    return max(0.0, float(((x == y).mean() - CHANCE) / (1 - CHANCE)))


def likeness(a: Column, b: Column) -> Column:
    """`alike` for columns."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), (same / BINS - CHANCE) / (1 - CHANCE)))


def _of(texts: list[str]) -> list[str]:
    sets = shingle_sets(pa.array(texts, pa.string()))
    return [packed(row, len(s)) for row, s in zip(digits(sets), sets)]


def fingerprints(docs: DataFrame, out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; a column of that name is replaced.

    Words are runs of anything but space and the controls 0x09 to 0x0D, A-Z as a-z. A text of one to four words is one shingle;
    one without words, null among them, has the empty fingerprint.
    """
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_of(part.column("text").to_pylist()), pa.string())], [*names, out])

    return small_batches(docs).select(*names).mapInArrow(run, docs.select(*names).schema.add(out, "string"))


def edited(text: str, after: str) -> str:
    """text whose last floor(n / 2) code points gave way to the first as many of another, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


#: Rows of a run of neighbours: a finished row, the last of a partition, whose neighbour is elsewhere, and the first of one, which is a neighbour.
_DONE, _LAST, _FIRST = 0, 1, 2
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _finished(doc_id: int | None, text: str, own: str, after: str, after_own: str) -> list:
    new = edited(text, after)
    own_new = _of([new])[0] if new != text else own
    return [doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, own_new, alike(own, own_new), alike(own, after_own)]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every document, the text that it becomes with its second half from the next document, and how alike the fingerprints are.

    docs has doc_id and text; other columns are not read. Documents follow one another by doc_id, null first, and rows of one doc_id by a
    hash of their texts; the last one is followed by the first. A null text is empty. A single row follows itself.

    Texts move once, to ranges of that order. Only where a range ends does a row need another task's: both texts are written
    with the results, one pair for each range, and meet in a join on the number of the range.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumns({"_h": F.xxhash64("text"), "_n": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_n"]  # equal rows are told apart only so that many of them can part
    ranges = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names = [f.split()[0] for f in _RESULT.split(", ")]
    schema = f"{_RESULT}, kind int, part int, text string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in names[2:5]), *((c, pa.float64()) for c in names[5:]), ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])

    def batch_of(found: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held: tuple | None = None
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                own = _of(texts)
                out = []
                if held is None:
                    out.append([ids[0], None, None, own[0], None, None, None, _FIRST, here, texts[0]])
                now = [held] * (held is not None) + list(zip(ids, texts, own))
                new = [edited(a[1], b[1]) for a, b in zip(now, now[1:])]
                new_own = _of(new)
                for a, b, text, mark in zip(now, now[1:], new, new_own):
                    sha = hashlib.sha256(text.encode()).hexdigest()
                    out.append([a[0], len(a[1]), sha, a[2], mark, alike(a[2], mark), alike(a[2], b[2]), _DONE, here, None])
                held = now[-1]
                if out:
                    yield batch_of(out)
        if held is not None:
            yield batch_of([[held[0], None, None, held[2], None, None, None, _LAST, here, held[1]]])

    found = cut(ranges.mapInArrow(run, schema))
    parts = [r["part"] for r in found.where(F.col("kind") == _FIRST).select("part").orderBy("part").collect()]  # a number for each range
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, then int")
    last = found.where(F.col("kind") == _LAST).select("doc_id", "text", "fingerprint", "part")
    first = found.where(F.col("kind") == _FIRST).select(F.col("part").alias("then"), F.col("text").alias("after"), F.col("fingerprint").alias("after_own"))
    pairs = last.join(F.broadcast(follows), "part").join(first, "then")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_finished(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names)

    rest = pairs.select("doc_id", "text", "fingerprint", "after", "after_own").mapInArrow(ends, _RESULT)
    return found.where(F.col("kind") == _DONE).select(*names).unionByName(rest)
