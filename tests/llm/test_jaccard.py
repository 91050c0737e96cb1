import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sheetwise.llm import jaccard
from sheetwise.llm.queries import QUERIES

from .conftest import reach

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(FOLD))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows):
    sets = brute_sets([t for _, t in rows])
    ids = [i for i, _ in rows]
    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in where.values() for x, a in enumerate(ks) for b in ks[x + 1 :]}
    links = [(ids[a], ids[b]) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = reach(ids, links)
    return sorted((i, len(s), comp[i]) for i, s in zip(ids, sets))


def near_copies(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w + [rng.choice(words) for _ in range(rng.randint(1, 30))]
            rows.append((k, " ".join(w) if rng.random() < 0.5 else "\n".join(w).upper()))
            k += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(40):
        rows.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(2, 90))) + " " + passage))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "  \t"), (k + 3, "one two"), (k + 4, "ONE\ntwo"), (k + 5, "one two three")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard.similar(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cid string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_without_pivots_whole_lists_find_all(spark, monkeypatch):
    rows = near_copies(3)
    monkeypatch.setattr(jaccard, "PIVOTS", 0)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op8_shingle_join"](spark, sf).collect())) == brute(rows)


def test_empty_table(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows(spark):
    t = " ".join(f"a{i}" for i in range(30))
    got = jaccard.similar(spark.createDataFrame([(4, t), (4, t), (2, t + " b"), (9, "q w e r t y")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(2, 27, 2), (4, 26, 2), (4, 26, 2), (9, 2, 9)]


def test_divide_skip_keeps_exact_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        q = np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(q)) < 0.15, rng.integers(0, 60, len(q)), q.astype(int))).astype(np.uint64) for _ in range(8)]
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(jaccard.divide_skip(q, sets)) == want


def test_shingle_counts():
    texts = ["A b c d e F", "a B c d e f", "x", None, "", "é É", "a b c d e a b c d e"]
    assert [len(s) for s in jaccard.shingle_sets(pa.array(texts))] == [len(s) for s in brute_sets(texts)]
    a, b = jaccard.shingle_sets(pa.array(texts[:2]))
    assert (a == b).all()


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    """Documents of one size that share a passage and do not link are compared in proportion to their number."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(100)]
    made = {}
    for n in (500, 2000):
        rows = [(i, " ".join([f"x{rng.randrange(1 << 40)}" for _ in range(30)] + passage)) for i in range(n)]
        pairs = []
        real = jaccard._check
        monkeypatch.setattr(jaccard, "_check", lambda p, t, real=real, pairs=pairs: (pairs.append(p.count()), real(p, t))[1])
        got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        monkeypatch.setattr(jaccard, "_check", real)
        assert all(r.component_id == r.doc_id and r.n_shingles == 126 for r in got)
        made[n] = sum(pairs)
    assert made[500] <= 3 * 500 * jaccard.PIVOTS and made[2000] <= 3 * 2000 * jaccard.PIVOTS


def test_near_copies_of_one_text_meet_in_its_middle(spark, monkeypatch):
    """Copies that link with their origin but not with each other are compared in proportion to their number."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(200):
        w = list(base)
        for at in rng.sample(range(10, 290), 0 if i == 120 else 5):
            w[at] = f"x{rng.randrange(1 << 40)}"
        rows.append((i, " ".join(w)))
    pairs, real = [], jaccard._check
    monkeypatch.setattr(jaccard, "_check", lambda p, t: (pairs.append(p.count()), real(p, t))[1])
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == 0 and r.n_shingles == 296 for r in got) and len(got) == 200
    assert sum(pairs) <= 200 * jaccard.PIVOTS


def test_lists_without_a_group_are_not_tried_again(spark):
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 4, 1), (2, 5, 1), (2, 6, 1)], "shingle long, cid long, times long").selectExpr("*", "3L members", "0 rank")
    known = spark.createDataFrame([(i, 10, [0]) for i in range(1, 7)], "cid long, n long, map array<long>")
    parts = spark.createDataFrame([(4, 4), (5, 4)], "node long, component long")
    got = jaccard._try(lists, parts, known, None, 1).collect()
    assert [r.b for r in got] == [6] and got[0].a in (4, 5)


def test_long_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = near_copies(4)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_one_row_clash_and_a_very_long_text(spark):
    t = " ".join(f"w{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, t, 5, "a"), (2, t + " end", 6, "b"), (None, "a b c d e f", 7, "c")], "doc_id long, text string, n long, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df).collect()}
    assert got == {1: (149_996, 1), 2: (149_997, 1), None: (2, None)}
    assert [tuple(r) for r in jaccard.similar(df.where("doc_id = 1")).collect()] == [(1, 149_996, 1)]
