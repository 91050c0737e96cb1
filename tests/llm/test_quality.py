import numpy as np

from sheetwise.llm import quality
from sheetwise.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, sf).collect()
    y = np.array([labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels])
    p = np.array([r.score for r in rows if r.held_out and r.doc_id in labels])
    guess = np.array([r.predicted for r in rows if r.held_out and r.doc_id in labels])
    auc = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    print("auc", auc, "accuracy", (guess == y).mean(), "good kept", guess[y == 1].mean(), "bad out", 1 - guess[y == 0].mean(), "brier", ((p - y) ** 2).mean(), len(y))
    assert auc > 0.9 and (guess == y).mean() > 0.9


def test_only_learns_from_rows_not_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.fit(docs, labels.where(~quality.held_out()), 50)
    b = quality.fit(docs, labels.where(~quality.held_out()).select("doc_id", "quality"), 50)
    assert a == b


def test_score_agrees_with_the_plain_library(spark, sf):
    import zstandard

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score(docs.select("doc_id", "text"), model).where("doc_id % 9 = 0").collect():
        raw = (r.text or "").encode()
        good, bad = (sum(len(p.compress(raw[i : i + 512])) for i in range(0, len(raw), 512)) for p in packers)
        gap = (bad - good) / max(good, bad) if raw else 0.0
        assert r.score == 1 / (1 + np.exp(-np.clip(model.slope * gap + model.bias, -40, 40)))


def test_calibration_is_the_best_curve():
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(3 * x - 1)))).astype(float)
    w = rng.uniform(0.5, 2, 400)
    a, b = quality._logistic(x, y, w)

    def loss(a, b):
        z = a * x + b
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-3 * a * a + 0.5e-6 * b * b

    assert all(loss(a, b) <= loss(a + s, b + t) + 1e-9 for s in (-0.01, 0, 0.01) for t in (-0.01, 0, 0.01))


def test_sample_has_whole_rows(spark):
    from sheetwise.llm.common import sample_rows

    df = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(50)] * 3 + [(None, None)], "doc_id long, text string")
    rows = sample_rows(df, 30, 3000, "s")
    assert sum(len(r["text"] or "") for r in rows) <= 3000 and len({r["doc_id"] for r in rows}) == len(rows) <= 30
    assert all(len(r["text"] or "") == 10 * (r["doc_id"] or 0) for r in rows)
    assert len(sample_rows(df, 1000, 1 << 20, "s")) == 51 and sample_rows(df.where("false"), 5, 5, "s") == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "good", 5, "x", "y")], "doc_id long, text string, held_out int, predicted string, _draw string")
    r = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert (r.held_out, r.predicted, r._draw) == (False, 1, "y")


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "abc " * 40_000, 0.5), (3, "abc", 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (3, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == 1 for r in got)
    both = spark.createDataFrame([(i, "good plain text number %d here" % i if i % 2 else "BAD!! BAD!! %d" % i) for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.classify(both, marks).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.8
    assert quality.classify(docs.where("false"), labels).collect() == []


def test_models_are_fitted_away_from_the_driver(spark, sf, monkeypatch):
    """No frame with texts is collected: both fits learn from their samples in a task."""
    from sheetwise.llm import pii

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(type(docs), name, lambda self, f=getattr(type(docs), name): seen.append(self.columns) or f(self))
    model, field = quality.fit(docs, labels.where(~quality.held_out()), 50), pii.fit(docs, 50)
    assert model.slope > 0 and field.unary.shape == (pii.FEATURES, len(pii.LABELS))
    assert seen and not any("text" in columns for columns in seen)
