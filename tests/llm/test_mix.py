import random

import pytest

from sheetwise.llm import mix

SCHEMA = "doc_id long, source string, text string, size int"


def fill(sizes, weights, limit=3):
    """Shares by weight; what is above a cap is shared again, until none is."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(limit * sizes[i] for i in capped)
        goal = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = {i for i in free if goal[i] > limit * sizes[i]}
        if not over:
            return [limit * sizes[i] if i in capped else goal[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i:02d}" for i in range(rng.randint(1, 9))] + [None]
    sizes = [rng.choice([0, 1, 10, 100, 5000]) for _ in names]
    got = {r.source: r for r in mix.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, size long")).collect()}
    want = fill(sizes, [i % 3 + 1 for i in range(len(names))])
    for n, s, t in zip(names, sizes, want):
        assert got[n].source_size == s and got[n].target == pytest.approx(t)


def rows(seed, n=600):
    rng = random.Random(seed)
    out = [(i, rng.choice(["a", "a", "a", "a", "a", "b", "c", "d", None]), " ".join("w" * rng.randint(1, 60)), 0) for i in range(n)]
    return out + [(n, "e", None, 0), (n + 1, "e", "", 0), (3, "a", "x y", 0), (3, "a", "x y", 0), (None, None, "q", 0)]


def test_mix(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    got = mix.mix(df.repartition(5), keep=("size", "text")).collect()
    assert len(got) == len(data)
    again = mix.mix(df.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.target, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    by, longest = {}, {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and len((r.text or "").split()) == r.size and r.in_size == 0
        by.setdefault((r.source_size, r.target), []).append(r.taken)
        longest[r.target] = max(longest.get(r.target, 0), r.size)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= longest[target] / 2 + 1e-6


def test_inclusion_is_even(spark):
    hits = 0
    df = spark.createDataFrame([(i, "b" if i < 400 else "a", "one", 0) for i in range(1000)], SCHEMA)
    first = [0] * 400
    for seed in range(12):
        for r in mix.mix(df, seed=str(seed)).where("doc_id < 400").collect():
            first[r.doc_id] += r.taken
            hits += r.taken
    assert hits == pytest.approx(12 * 1000 * 2 / 3, rel=0.01)
    mean = hits / 400
    assert max(first) < 2 * mean and min(first) > 0.5 * mean


def requested(docs, limit=3):
    """Expected copies of each document, by bisection on the level c of min(1, c * measure)."""
    sizes = {}
    for _, source, text, _ in docs:
        sizes.setdefault(source, []).append(len(text.split()))
    names = sorted(sizes)
    goal = dict(zip(names, fill([sum(sizes[n]) for n in names], [i % 3 + 1 for i in range(len(names))], limit)))
    out = {}
    for n in names:
        measure = [mix.LEAN + max(s, 1).bit_length() - 1 for s in sizes[n]]
        whole = int(goal[n] / sum(sizes[n]) + 1e-12)
        rest, lo, hi = goal[n] - whole * sum(sizes[n]), 0.0, 1.0
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(1, c * g) * s for g, s in zip(measure, sizes[n])) < rest else (lo, c)
        for g in set(measure):
            out[n, g] = whole + min(1, hi * g)
    return out


def test_inclusion_follows_the_requested_odds(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("aabbbc"), "w " * (1 << rng.randint(0, 9)), 0) for i in range(30_000)]
    want = requested(data)
    seen = {}
    for r in mix.mix(spark.createDataFrame(data, SCHEMA)).collect():
        seen.setdefault((data[r.doc_id][1], mix.LEAN + r.size.bit_length() - 1), []).append(r.copies)
    assert set(seen) == set(want)
    for k, copies in seen.items():
        p = want[k] % 1
        assert abs(sum(copies) / len(copies) - want[k]) <= 4 * (p * (1 - p) / len(copies)) ** 0.5 + 2 / len(copies), k
        assert set(copies) <= {int(want[k]), int(want[k]) + 1}
    for source in "abc":  # longer documents are likelier wherever a sample is drawn
        odds = [want[source, mix.LEAN + j] for j in range(10)]
        assert odds == sorted(odds) and (odds[0] == int(odds[0]) or odds[0] < odds[-1])


def test_certain_copies_leave_the_ranking(spark):
    data = [(i, "a", "w " * 1000, 0) for i in range(30)] + [(30 + i, "a", "w", 0) for i in range(30)] + [(100 + i, "b", "w " * 400, 0) for i in range(100)]
    want = requested(data)
    for r in mix.mix(spark.createDataFrame(data, SCHEMA)).collect():
        w = want[data[[d[0] for d in data].index(r.doc_id)][1], mix.LEAN + r.size.bit_length() - 1]
        assert r.copies in (int(w), -int(-w // 1))


def test_empty(spark):
    assert mix.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_kept_columns_of_any_name(spark):
    names = ("of", "g", "p", "q", "u", "rest", "bucket", "taken", "_kept", "source", "whole")
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i + 1), *(10 * i + k for k in range(len(names) - 2))) for i in range(8)], "doc_id long, source string, text string, " + ", ".join(f"`{n}` int" for n in names if n not in ("source", "whole")))
    df = df.withColumn("whole", df.of)
    for r in mix.mix(df, keep=names).collect():
        assert (r["of"], r["g"], r["in_taken"], r["source"], r["whole"]) == (10 * r.doc_id, 10 * r.doc_id + 1, 10 * r.doc_id + 7, "ab"[r.doc_id % 2], 10 * r.doc_id)
