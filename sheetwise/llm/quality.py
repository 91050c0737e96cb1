"""A compression classifier of text quality: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, pieces, sample, small_batches

#: Bounds of the sample of labelled rows that a model is fitted on, for each class: rows, and bytes of their whole texts.
SAMPLE_DOCS, SAMPLE_BYTES = 5000, 16 << 20
DICT_BYTES, CHUNK, LEVEL = 400 << 10, 512, 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float

    def sizes(self) -> CompressedSizes:
        return CompressedSizes(self.good, self.bad)

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.bias, -40, 40)))


class CompressedSizes:
    """Normalised difference of a text's compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = _compressor(good), _compressor(bad)

    def difference(self, text: bytes) -> float:
        """(bad - good) / the larger, over all chunks of the whole text; positive is closer to good. 0 for an empty text."""
        g = b = 0
        for part in chunks(text):
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
        return (b - g) / max(b, g) if g else 0.0


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of few or short samples, which cannot be trained on, their own content."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:size] or b"no text"


def chunks(text: bytes) -> list[bytes]:
    return [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, budget: int = SAMPLE_BYTES) -> Model:
    """Learns both dictionaries and the calibration from labelled documents.

    labels has doc_id and quality (0 or 1; null is ignored). The sample is bounded: per_class documents
    of each class and `budget` bytes, the smallest draws of a hash of doc_id, with their whole texts. Two thirds make the dictionaries; the others,
    which no dictionary has seen, fit the logistic curve on whole texts as they are scored, weighted to the classes' true shares.
    One task learns from the sample, so that no text reaches the driver; the model is all that does.
    Without both classes the score is 1 for everything, so that nothing is rejected unlearned.
    """
    totals = {int(r["quality"]): int(r["count"]) for r in labels.where("quality IN (0, 1)").groupBy("quality").count().collect()}
    of = lambda q: sample(docs.select("doc_id", "text"), per_class, budget, "quality", labels.where(F.col("quality") == q).select("doc_id"))
    both = reduce(DataFrame.union, [of(q).select(F.lit(q).alias("class"), "_draw", "_key", "text") for q in (0, 1)])

    def learn(found: pa.Table) -> pa.Table:
        model = _learn({q: [(r["text"] or "").encode() for r in in_order(found.filter(pc.equal(found.column("class"), q)))] for q in (0, 1)}, totals)
        return pa.table({"good": pa.array([model.good], pa.binary()), "bad": pa.array([model.bad], pa.binary()), "slope": [model.slope], "bias": [model.bias]})

    row = both.groupBy().applyInArrow(learn, "good binary, bad binary, slope double, bias double").first()
    return Model(bytes(row["good"]), bytes(row["bad"]), row["slope"], row["bias"]) if row else _learn({0: [], 1: []}, totals)


def _learn(sampled: dict[int, list[bytes]], totals: dict[int, int]) -> Model:
    """The model of the sampled texts of each class."""
    split: dict[int, list[bytes]] = {}
    rest: list[tuple[int, bytes]] = []
    for q, texts in sampled.items():
        split[q] = [t for i, t in enumerate(texts) if i % 3 != 2]
        rest += [(q, t) for i, t in enumerate(texts) if i % 3 == 2]
    if not split[0] or not split[1] or len({q for q, _ in rest}) < 2:
        return Model(b"no text", b"no text", 0.0, 40.0)
    good, bad = (build_dictionary([c for t in split[q] for c in chunks(t)]) for q in (1, 0))
    sizes = CompressedSizes(good, bad)
    x = np.array([sizes.difference(t) for _, t in rest])
    y = np.array([q for q, _ in rest], float)
    weight = np.where(y == 1, totals.get(1, 1) / max(1, (y == 1).sum()), totals.get(0, 1) / max(1, (y == 0).sum()))
    slope, bias = _logistic(x, y, weight / weight.mean())
    return Model(good, bad, slope, bias)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Newton steps on the weighted log loss with a small ridge."""
    a = np.column_stack([x, np.ones_like(x)])
    beta = np.zeros(2)
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, the probability of label 1. Whole texts count; null and empty ones score by the bias alone.

    The model, two dictionaries of at most 400 KiB and two numbers, travels with the tasks. A column
    named score already there is replaced.
    """
    names = [c for c in docs.columns if c != "score"]
    schema = docs.select(*names).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for batch in batches:
            for part in pieces(batch, "text"):
                x = np.array([sizes.difference(t.as_buffer().to_pybytes()) if t.is_valid else 0.0 for t in part.column("text").cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.probability(x))], [*names, "score"])

    return small_batches(docs).select(*names).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fits on the labels that are not held out and scores all of docs: `held_out`, `score` and `predicted` are added.

    A null doc_id is not held out and has no label. Columns of docs with these three names are replaced. Empty tables give no rows.
    """
    model = fit(docs, labels.where(~held_out()))
    out = score(docs, model)
    return out.withColumns({"held_out": F.coalesce(held_out(), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
