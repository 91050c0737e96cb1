import hashlib
import random
import re
from functools import cache

import pytest

from sheetwise.llm import turns

NEXT = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def fault(i, rows):
    role, text = rows[i]
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return "blank"
    if rows[i] in rows[:i]:
        return "duplicate"
    return "truncated" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?" else ""


def cheapest(rows):
    """(cost, audit, lines): every sequence of edits, one at a time."""
    bad = [fault(i, rows) for i in range(len(rows))]

    @cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def then(cost, letter, line, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if inserted < 3:
            role = NEXT[state]
            then(3, "I", (f"{role}:",), best(i, role[0], inserted + 1))
        if i < len(rows):
            role, text = rows[i]
            then(4, "D", (), best(i + 1, state, 0))
            if bad[i] not in ("blank", "duplicate"):
                more = 3 * (bad[i] == "truncated")
                if role[:1] == NEXT[state][0] or role[:1] == "s" and state == "":
                    then(more, "K", (f"{role}:{text}",), best(i + 1, role[:1], 0))
                for to in ("user", "assistant"):
                    if to == NEXT[state]:
                        then(3 + more, "R", (f"{to}:{text}",), best(i + 1, to[0], 0))
        return min(found) if found else None

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in NEXT:
            best(i, state, 0)
    return best(0, "", 0)


def want(rows):
    """By conversation, from rows of conv_id, turn, role, text."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        said = [(role or "", text or "") for _, role, text in own]
        numbers = [t for t, _, _ in own if t is not None]
        bad = [fault(i, said) for i in range(len(said))]
        legal = [a[0][:1] + b[0][:1] in ("su", "ua", "au") for a, b in zip(said, said[1:])]
        cost, audit, lines = cheapest(said)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(bad.count(f) for f in ("blank", "duplicate", "truncated")), legal.count(False), cost, audit, sha if lines else None)
    return out


def got(spark, rows, span, shuffled=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, number int, key string").repartition(shuffled)
    audits, repaired = turns.repair(df, span)
    said = {r.key: r.sha256 for r in turns.digests(repaired).collect()}
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, said.get(r.key)) for r in audits.collect()}
    assert len(out) == audits.count()
    return out


def some_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in enumerate(sizes):
        for i in range(n):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "Assistant", None])
            text = rng.choice(["a.", "b?", "c! \n", "cut", " ", "", None, f"{i}.", f"{i}", "long. " * 30, "é."])
            turn = rng.choice([i, i, i, i + 1, None])
            rows += [(conv if conv != 3 else None, turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("span", [2, 3, 256])
def test_against_every_sequence_of_edits(spark, span):
    rows = some_rows(span, [1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 40])
    assert got(spark, rows, span) == want(rows)


def test_long_conversations_span_many_blocks(spark):
    """One conversation with most of the rows, over several ranges and levels."""
    rows = some_rows(7, [300, 2, 0, 4])
    assert got(spark, rows, 4, 8) == want(rows)


def test_repaired_turns_fit_the_grammar(spark):
    df = spark.createDataFrame(some_rows(5, [6] * 30), "conv_id long, turn long, role string, text string")
    audits, repaired = turns.repair(df, 5)
    by = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.key, r.number, r.place)):
        by.setdefault(r.key, []).append(r)
    for a in audits.collect():
        there = by.get(a.key, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in there))
        assert [r.edit for r in there] == [c for c in a.audit if c != "D"] and all(r.text == "" for r in there if r.edit == "I")


def test_ties_take_the_least_audit(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "user", "a."), (3, 0, "assistant", "x."), (4, 0, "system", "x.")]
    out = got(spark, rows, 256)
    assert {k: v[5:7] for k, v in out.items()} == {1: (3, "KR"), 2: (3, "KI"), 3: (3, "IK"), 4: (4, "D")}


def test_damage_and_no_rows(spark):
    import zlib

    rows = [(c, t, "assistant", f"{c}. {t}! What?") for c in range(40) for t in range(6)] + [(None, None, None, None), (40, 3, None, "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expect = []
    for c, t, role, text in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if lot == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(lot, text))
        expect += [row] * {0: 0, 3: 2}.get(lot, 1)
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, turns.damage(df).collect()), key=key) == sorted(expect, key=key)
    full = want(expect)
    nothing = hashlib.sha256(b"").hexdigest()
    out = {r.conv_id: tuple(r)[1:] for r in turns.repair_damaged(df).collect()}
    assert out == {c: (*full[c][:-1], full[c][-1] or nothing) if c in full else (0, 0, 0, 0, 0, 0, "", nothing) for c in {r[0] for r in rows}}
    lost = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = turns.repair_damaged(spark.createDataFrame([(lost, 0, "user", "x")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(x) for x in r] == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert turns.repair_damaged(df.where("false")).collect() == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 2_000_000), (1, 1, "assistant", "y. " * 500_000), (1, 2, "user", " " * 1_000_000)]
    assert got(spark, rows, 256) == want(rows)
