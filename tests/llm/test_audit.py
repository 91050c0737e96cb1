import re
from collections import defaultdict
from itertools import permutations

from sheetwise.llm import audit


def brute(docs, labels):
    """Each order applied to each document, one filter after another."""
    label = defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        if doc is not None:
            label[doc] = [max(label[doc][0], quality == 1), max(label[doc][1], toxic == 1)]
    seen = defaultdict(list)
    for doc, text, _ in docs:
        if doc is not None:
            seen[text or ""].append(doc)
    fails = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(x < doc for x in seen[text]),
        }
        fails.append((lang or "", {k for k in f if f[k]}, *(label[doc] if doc is not None else (0, 0))))
    out, shapley = {}, defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in fails}:
            left = [x for x in fails if x[0] == part]
            for step, name in enumerate(order, 1):
                there = [x for x in fails if x[0] == part and name in x[1]]
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[part, name] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(there) - len(gone), sum(x[1] == {name} for x in there), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = audit.interactions(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_every_order_against_one_filter_after_another(spark):
    long = " ".join(f"w{i}" for i in range(230))
    texts = [long, long + " #", "A" + long, "AB " * 250, "x " * 300, "a|b", "", None, long.upper(), "é" * 5000 + "ABC", "x y \x0b z $"]
    docs = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang in ("en", None, "", "fr") for t in texts)]
    docs += [(3, "AB " * 250, "en"), (3, "other text", "en"), (None, long, "fr"), (None, long, "fr"), (-5, "", "de"), (7, long, "de")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 44, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (999, 1, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_no_rows_and_no_labels(spark):
    assert got(spark, [], []) == {}
    docs = [(1, None, None)]
    assert got(spark, docs, []) == brute(docs, [])
    assert len(got(spark, docs, [])) == 600


def test_clashing_columns_and_long_texts(spark):
    docs = [(i, "word " * 200_000 if i % 2 else "B" * 300_000, "en") for i in range(4)]
    d = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in docs], "doc_id long, text string, lang string, mask int, _id int, part int, digest int")
    lab = spark.createDataFrame([(1, 1, 0, 5)], "doc_id long, quality int, toxic int, lang int")
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(d, lab).collect()}
    assert out == brute(docs, [(1, 1, 0)])


def test_a_text_of_many_copies_joins_one_row(spark):
    """Rows of a popular text meet the least doc_id of it by their own id, so the join sees one match."""
    d = spark.range(3000).selectExpr("id AS doc_id", "'same' AS text", "'en' AS lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {r["mask"]: r["count"] for r in audit.masks(d, labels).groupBy("mask").count().collect()}
    assert counts == {1: 1, 17: 2999}
