"""Best-fit packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, small_batches, text_buffer

CAPACITY, SEPARATOR = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct words kept in a worker's memory; the table is emptied when it is full.
KNOWN_WORDS = 100_000
#: Code points whose classes are the same in every Unicode version of the last twenty years.
PLAIN = 0x0250
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0


class ByteBPE:
    """Ids of the byte-level BPE in a tokenizer file, for whole batches at once.

    Texts are cut into words by array operations, different words are encoded once, and ids are gathered. Where the
    file's ids are the order of its merges, a word goes through a rank table, which is faster than the library and gives
    the same ids. Texts with unusual code points, or with a special token's string, go through the library as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = [vocab[a + b] for a, b in merges]
        self.encode_word = self._library_word
        if all(x < y for x, y in zip(ids, ids[1:])):  # then the ids are ranks too
            import tiktoken

            back = _byte_alphabet()
            ranks = {bytes(back[c] for c in word): i for word, i in vocab.items() if word not in self.special and all(c in back for c in word)}
            self.encode_word = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, list[int]] = {}
        rng = np.random.default_rng(20240229)
        self.value = rng.integers(1, 1 << 63, PLAIN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.kind = np.full(PLAIN, _OTHER, np.uint8)
        for i in range(PLAIN):
            c = chr(i)
            self.kind[i] = _SPACE if c.isspace() and not 0x1C <= i <= 0x1F else _LETTER if c.isalpha() else _NUMBER if c.isnumeric() else _OTHER
        self.power = self.inverse = np.ones(1, np.uint64)

    def _library_word(self, word: str) -> list[int]:
        return self.library.encode(word, add_special_tokens=False).ids

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            for name, x in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        raw, offsets = text_buffer(array)
        n = len(offsets) - 1
        data = raw.tobytes()
        text = data.decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets] if len(raw) else np.zeros(n + 1, np.int64)
        odd = np.concatenate([[0], np.cumsum(cp >= PLAIN)])
        slow = (odd[begins[1:]] - odd[begins[:-1]]) > 0
        for token in self.special:
            if token in text:
                slow |= np.array([token in text[a:b] for a, b in zip(begins[:-1], begins[1:])], bool)
        if slow.any():
            parts, counts, fast = [], np.zeros(n, np.int64), np.flatnonzero(~slow)
            plain = [text[begins[i] : begins[i + 1]] for i in fast]
            joined = "".join(plain)
            at = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)
            quick = self._fast(joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), at)
            ends = np.concatenate([[0], np.cumsum(quick[1])])
            turn = {int(i): k for k, i in enumerate(fast)}
            for i in range(n):
                ids = quick[0][ends[turn[i]] : ends[turn[i] + 1]] if i in turn else np.array(self.library.encode(text[begins[i] : begins[i + 1]], add_special_tokens=False).ids, np.uint32)
                parts.append(ids)
                counts[i] = len(ids)
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts
        return self._fast(text, cp, begins)

    @staticmethod
    def _exact(cp: np.ndarray, text: str, words: np.ndarray, ends: np.ndarray, where: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grouping of words by their marks, if words of one mark are equal throughout; else that by the words themselves."""
        first, size = words[where][which], ends - words
        if (size == size[where][which]).all() and (cp[np.arange(len(cp)) + np.repeat(first - words, size)] == cp).all():
            return where, which
        turn: dict[str, int] = {}
        which = np.array([turn.setdefault(text[a:b], len(turn)) for a, b in zip(words.tolist(), ends.tolist())])
        return np.unique(which, return_index=True)[1], which

    def _fast(self, text: str, cp: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, n = len(cp), len(begins) - 1
        if not size:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        kind = self.kind[cp]
        first = np.zeros(size + 1, bool)
        first[begins] = True  # of a text; one past the end too
        run = first[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        blank = cp == 0x20
        start = run.copy()
        # a run of white space before other text leaves its last character to what follows
        last = np.zeros(size, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
        start |= last
        joined = np.zeros(size, bool)
        joined[1:] = last[:-1] & blank[:-1]
        start &= ~joined
        # contractions: a lone apostrophe that starts a word takes one or two letters with it
        quote = np.flatnonzero((cp == 0x27) & start)
        if len(quote):
            pad = np.concatenate([cp, np.zeros(3, np.uint32)])
            edge = np.concatenate([first, np.ones(3, bool)])
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, [0x73, 0x74, 0x6D, 0x64]) & ~edge[quote + 1]
            two = (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))) & ~edge[quote + 1] & ~edge[quote + 2]
            for hit, k in ((one, 1), (two & ~one, 2)):
                q = quote[hit]
                start[q + 1] = False
                q = q[q + 1 + k < size]
                start[q + 1 + k] = True
        words = np.flatnonzero(start)
        ends = np.append(words[1:], size)
        self._powers(size)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[cp] * self.power[:size])])
        mark = (sums[ends] - sums[words]) * self.inverse[words]
        _, where, which = np.unique(mark, return_index=True, return_inverse=True)
        where, which = self._exact(cp, text, words, ends, where, which)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = []
        for a, b in zip(words[where].tolist(), ends[where].tolist()):
            word = text[a:b]
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self.encode_word(word)
            out.append(ids)
        lens = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.uint32, int(lens.sum()))
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        each = lens[which]
        done = np.cumsum(each)
        ids = flat[np.repeat(at[which] - (done - each), each) + np.arange(done[-1])]
        cuts = np.searchsorted(words, begins)
        total = np.concatenate([[0], done])
        return ids, np.diff(total[cuts])


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    back = {chr(b): b for b in plain}
    back.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return back


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """A row for each piece of each document: its ids' place, number and CRC.

    A document's ids end with the separator. Longer ones than the capacity are cut; all pieces but the
    first are full. A null or empty text is the separator alone. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, counts = bpe.encode(part.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, separator).astype("<u4")
                counts = counts + 1
                begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = counts - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = begins[doc] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (sizes inside, how many such bins), from the number of items of each size.

    Items above a third of the capacity are matched first, largest with the largest that fits beside
    it, two to a bin at most. Smaller ones, largest first, go where the gap is smallest. The plan
    works on sizes, so its cost depends on the capacity and not on the number of items.
    """
    left = [0] * (capacity + 1)
    for s, k in counts.items():
        left[s] = k
    third = capacity // 3
    by_gap: dict[int, list[tuple[list[int], int]]] = {}

    def put(inside: list[int], k: int) -> None:
        if k:
            by_gap.setdefault(capacity - sum(inside), []).append((inside, k))

    for s in range(capacity, third, -1):
        while left[s]:
            t = next((t for t in range(min(s, capacity - s), third, -1) if left[t] - (t == s) > 0), 0)
            if not t:
                put([s], left[s])
                left[s] = 0
            elif t == s:
                pairs = left[s] // 2
                put([s, s], pairs)
                left[s] -= 2 * pairs
            else:
                k = min(left[s], left[t])
                put([s, t], k)
                left[s] -= k
                left[t] -= k
    for s in range(third, 0, -1):
        gap = s
        while left[s]:
            while gap <= capacity and not by_gap.get(gap):
                gap += 1
            if gap > capacity:
                m = capacity // s
                put([s] * m, left[s] // m)
                put([s] * (left[s] % m), 1 if left[s] % m else 0)
                left[s] = 0
                break
            inside, k = by_gap[gap].pop()
            m = gap // s
            full = min(k, left[s] // m)
            put(inside + [s] * m, full)
            left[s] -= full * m
            rest = k - full
            if rest and left[s]:  # fewer than m are left
                put(inside + [s] * left[s], 1)
                left[s] = 0
                rest -= 1
            put(inside, rest)
    return [x for g in sorted(by_gap) for x in by_gap[g]]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset.

    Only the number of pieces by length, at most `capacity` rows, reaches the driver, where the plan
    is made. Pieces of one length are interchangeable: a piece's rank among them selects its slot.
    Ranks are running counts inside a task's rows plus those of the tasks before, so no length, however
    frequent, meets in one task. An empty table gives no rows; extra columns are not read.
    """
    made = cut(cut_pieces(docs, path, capacity, separator).withColumn("part", F.spark_partition_id()))
    tally = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    sizes = {int(r["length"]): int(r["n"]) for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, first = [], dict.fromkeys(sizes, 0)
    sequence = 0
    for inside, k in plan(sizes, capacity):
        offset = 0
        for s in inside:
            slots.append((s, first[s], sequence, offset))
            first[s] += k
            offset += s
        sequence += k
    slots.sort()
    key = np.array([(s << 44) + r for s, r, _, _ in slots], np.int64)
    base = np.array([r for _, r, _, _ in slots], np.int64)
    seq = np.array([q for _, _, q, _ in slots], np.int64)
    offs = np.array([o for _, _, _, o in slots], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            cols = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(seq[at] + rank - base[at]), pa.array(offs[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = tally.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("length").alias("_l"), F.col("part").alias("_p"), "shift")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = made.withColumn("row", F.row_number().over(own) - 1).join(shift, (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
