import pytest

from sheetwise.llm.common import table

pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    import corpus_pipeline as p

    from sheetwise.llm import quality

    from .test_jaccard import brute
    from .test_packing import check
    from .test_pii import plain

    docs = table(spark, sf, "documents")
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5
    first = p.classify(spark, docs, sf).cache()
    assert first.columns == docs.columns
    want = {r.doc_id for r in quality.classify(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in first.collect()} == want
    good = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()}
    assert len(good & want) >= 0.97 * len(good)
    second = p.unique(spark, first, sf).cache()
    assert {r.doc_id for r in second.collect()} == {c for _, _, c in brute([(r.doc_id, r.text) for r in first.collect()])}
    third = p.private(spark, second, sf).cache()
    assert third.count() == second.count() and all(not plain(r.text) and r.n_chars == len(r.text) for r in third.collect())
    fourth = p.mixed(spark, third, sf).cache()
    texts = {r.doc_id: r.text for r in third.collect()}
    rows = fourth.collect()
    assert fourth.columns == docs.columns and all(texts[r.doc_id] == r.text for r in rows)
    words = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r.text.split()) for r in rows) - words) < 0.1 * words
    last = p.packed(spark, fourth, sf).collect()
    from collections import Counter

    copies = Counter(r.doc_id for r in rows)
    assert Counter(r.doc_id for r in last if r.piece == 0) == copies


def test_each_stage_on_odd_rows(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows, one doc_id with two texts, clashing columns, no rows."""
    import corpus_pipeline as p

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "one two three four five six seven", "en", "a", 5), (1, "one two three four five six seven", "en", "a", 5), (1, "other words stand here under that id", "en", "a", None),
            (2, None, None, None, None), (3, "", "en", "b", 0), (None, "one two three four five six seven", "en", "a", 5), (None, None, None, None, None), (7, long, "en", "b", 1), (9, long + " more", "en", "b", 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row long, component_id string")
    second = p.unique(spark, df, sf).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in second) == sorted([(1, 33), (1, 36), (2, 0), (3, 0), (0, 0), (7, len(long))])
    for _, stage in p.STAGES:
        out = stage(spark, df, sf)
        assert stage is p.packed or out.columns == list(p.COLUMNS)
        out.collect()
        assert stage(spark, df.where("false"), sf).collect() == []
    private = p.private(spark, df, sf).collect()
    assert sorted(r.doc_id or 0 for r in private) == sorted(r[0] or 0 for r in rows) and sum(r.text is None for r in private) == 2
