"""Personal data by fixed patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_order, pieces, sample, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Bounds of the sample that the field is fitted on: so many documents that hold a digit or an @, and bytes of their whole texts.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 8 << 20
#: An added span's least marginal probability.
SURE = 0.9
#: Prior log weight of equal labels on a skip link, for kinds that never repeat in the sample.
AGREE = 3.0
ROUNDS, DAMPING, BLOCK = 12, 0.5, 1 << 17

Span = tuple[int, int, int]  # kind as an index of KINDS, start, end

_ANY = re.compile(r"[0-9@]")
# The characters of the patterns in the operator's contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each @ has one run of local characters before it, so a scan from @ to @ is the leftmost search in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            yield 0, start, free
        else:
            free = max(free, at)  # a later run cannot reach over this @
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    """Chains of dotted numbers, cut into fours from the left."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield 1, at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by kind, then start. Leftmost, not overlapping within a kind; failing ones are dropped."""
    if not _ANY.search(text):
        return []
    out = [*_emails(text), *_ips(text)]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# ---- the field ----

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = 24


@dataclass
class Graph:
    """Tokens with a digit or an @ of one or more documents. Other words are labelled none and cut the chain."""

    x: np.ndarray  # features of each token
    fixed: np.ndarray  # the base kind of a token, as a label; -1 where there is none
    chain: np.ndarray  # pairs of tokens with at most one word between
    skip: np.ndarray  # pairs of distant tokens that are equal or similar
    where: list[tuple[int, int]]
    doc: np.ndarray


def _tokens(text: str) -> Iterator[re.Match]:
    return (m for m in _WORD.finditer(text) if _ANY.search(m.group()))


def _features(text: str, a: int, b: int) -> list[float]:
    token = text[a:b]
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    plain = _NO_DIGIT.sub("", token)
    before = text[max(0, a - 2) : a]
    f = [
        1.0, "@" in token, bool(re.search(r"@[^.]+\.[^.]", token)), token.count(".") >= 3, token.count(".") in (1, 2), "+" in token[:2],
        "-" in token, "(" in token or ")" in token, digits == 0, 0 < digits < 3, 3 <= digits < 7, 7 <= digits < 9, 9 <= digits < 13,
        13 <= digits <= 19, digits > 19, letters == 0, 0 < letters <= 3, letters > 3, 13 <= len(plain) <= 19 and luhn(plain), "=" in token,
        token.isupper(), before.endswith("\n") or a == 0, len(token) > 30, "%" in token or "/" in token,
    ]
    return [float(v) for v in f]


def _keys(token: str) -> list[str]:
    """What equal and similar tokens have in common: their letters and digits folded; their digits, if seven or more."""
    folded = "".join(c for c in token.casefold() if c.isalnum() or c == "@")
    digits = "".join(c for c in token if "0" <= c <= "9")
    keys = ["=" + folded] if len(folded) >= 5 else []
    return [*keys, "#" + digits] if len(digits) >= 7 else keys


def graph(texts: list[str], bases: list[list[Span]]) -> Graph:
    """Tokens and links of a batch. A repeated token is linked with its last occurrence and with the first, so links grow linearly."""
    x, fixed, chain, skip, where, doc = [], [], [], [], [], []
    for d, (text, spans) in enumerate(zip(texts, bases)):
        seen: dict[str, tuple[int, int]] = {}
        last_end, order = -1, sorted(spans, key=lambda s: s[1])
        at = 0
        for m in _tokens(text):
            a, b = m.span()
            i = len(x)
            while at < len(order) and order[at][2] <= a:
                at += 1
            hit = next((s for s in order[at : at + 8] if s[1] < b and s[2] > a), None)
            x.append(_features(text, a, b))
            fixed.append(1 + hit[0] if hit else -1)
            where.append((a, b))
            doc.append(d)
            if last_end >= 0 and len(text[last_end:a].split(None, 2)) <= 1 and a - last_end < 40:
                chain.append((i - 1, i))
            last_end = b
            for key in _keys(m.group()):
                if key in seen:
                    first, last = seen[key]
                    skip.append((last, i))
                    if first != last:
                        skip.append((first, i))
                    seen[key] = (first, i)
                else:
                    seen[key] = (i, i)
    pairs = lambda p: np.array(p, np.int64).reshape(-1, 2)
    return Graph(np.array(x).reshape(-1, FEATURES), np.array(fixed, np.int64), pairs(chain), np.unique(pairs(skip), axis=0), where, np.array(doc, np.int64))


@dataclass(frozen=True)
class Field:
    """Weights: of each feature for each label, and of each pair of labels on chain and on skip links."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, clamp: bool = True) -> np.ndarray:
        """Loopy sum-product with damping, for all tokens of a batch at once; tokens of base spans are evidence."""
        k = len(LABELS)
        theta = g.x @ self.unary
        if clamp:
            held = g.fixed >= 0
            theta[held] = -50.0
            theta[held, g.fixed[held]] = 0.0
        weights = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])
        ends = np.concatenate([g.chain, g.skip])
        m = len(ends)
        sort = np.repeat([0, 1, 2, 3], [len(g.chain), len(g.skip)] * 2)
        src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, k))
        for _ in range(ROUNDS if m else 0):
            belief = theta.copy()
            np.add.at(belief, dst, message)
            sent = belief[src] - message[back]
            for lo in range(0, 2 * m, BLOCK):  # bounds the pairwise tables of a very long document
                part = slice(lo, lo + BLOCK)
                new = _lse(sent[part, :, None] + weights[sort[part]], 1)
                message[part] = DAMPING * message[part] + (1 - DAMPING) * (new - _lse(new, 1)[:, None])
        belief = theta.copy()
        if m:
            np.add.at(belief, dst, message)
        return np.exp(belief - _lse(belief, 1)[:, None])


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis))


def train(texts: list[str], rounds: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximises the pseudo-likelihood, each token given its neighbours' labels, with base kinds as labels.

    Token features never hold the base label itself, so the field learns what the kinds look like and
    how linked tokens agree. Without tokens, only the prior for agreement is left.
    """
    k = len(LABELS)
    g = graph(texts, [base_spans(t) for t in texts])
    y = np.maximum(g.fixed, 0)
    agree = AGREE * np.eye(k)
    unary, chain, skip = np.zeros((FEATURES, k)), np.zeros((k, k)), agree.copy()
    unary[0, 0] = 1.0
    if not len(y):
        return Field(unary, chain, skip)
    hot = np.eye(k)[y]
    step = [np.full_like(w, 1e-8) for w in (unary, chain, skip)]
    for _ in range(rounds):
        theta = g.x @ unary
        for ends, w in ((g.chain, chain), (g.skip, skip)):
            np.add.at(theta, ends[:, 1], w[y[ends[:, 0]]])
            np.add.at(theta, ends[:, 0], w.T[y[ends[:, 1]]])
        gap = hot - np.exp(theta - _lse(theta, 1)[:, None])
        grads = [g.x.T @ gap / len(y) - ridge * unary]
        for ends, w, prior in ((g.chain, chain, 0), (g.skip, skip, agree)):
            d = hot[ends[:, 0]].T @ gap[ends[:, 1]] + gap[ends[:, 0]].T @ hot[ends[:, 1]]
            grads.append(d / len(y) - ridge * (w - prior))
        for w, d, s in zip((unary, chain, skip), grads, step):
            s += d * d
            w += rate * d / np.sqrt(s)
    return Field(unary, chain, (skip + skip.T) / 2)


def added_spans(texts: list[str], bases: list[list[Span]], field: Field, sure: float = SURE) -> list[list[Span]]:
    """Spans of tokens outside base spans whose kind is sure and that a skip link ties to a repeated or similar token, in a base span or not."""
    out: list[list[Span]] = [[] for _ in texts]
    g = graph(texts, bases)
    if not len(g.x) or not len(g.skip):
        return out
    p = field.marginals(g)
    linked = np.zeros(len(g.x), bool)
    linked[g.skip.ravel()] = True
    best = p.argmax(1)
    for i in np.flatnonzero(linked & (g.fixed < 0) & (best > 0) & (p.max(1) >= sure)):
        a, b = g.where[i]
        text = texts[g.doc[i]]
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            out[g.doc[i]].append((int(best[i]) - 1, a, b))
    return out


def fit(docs: DataFrame, n: int = SAMPLE_DOCS, budget: int = SAMPLE_BYTES) -> Field:
    """The field, fitted on whole texts of at most n documents with a digit or an @: the smallest draws of a hash of doc_id, `budget` bytes at most.

    One task trains it, so that no text reaches the driver; the weights are all that does.
    """
    some = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))

    def learn(found: pa.Table) -> pa.Table:
        field = train([r["text"] for r in in_order(found)])
        return pa.table({name: pa.array([getattr(field, name).ravel().tolist()], pa.list_(pa.float64())) for name in ("unary", "chain", "skip")})

    row = sample(some, n, budget, "pii").select("_draw", "_key", "text").groupBy().applyInArrow(learn, "unary array<double>, chain array<double>, skip array<double>").first()
    return Field(*(np.array(w).reshape(-1, len(LABELS)) for w in row)) if row else train([])


def find(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """The columns in keep, counts of base spans, their digest, and all spans of every whole text.

    With redact, `text` is added with each span replaced by its kind in brackets. Null texts count as
    empty. Each row is judged by itself: repeated rows give repeated results, an empty table none.
    """
    keep = tuple(dict.fromkeys(keep))
    kept = [c for c in keep if not (redact and c == "text")]
    schema = docs.select(*kept).schema
    for name, kind in (*((f"n_{k}", "long") for k in KINDS), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(f"pii_{name}" if redact else name, kind)
    if redact:
        schema = schema.add("text", "string")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = fresh("_text", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, whole):
                texts = [t or "" for t in part.column(whole).to_pylist()]
                n = len(texts)
                busy = [i for i, t in enumerate(texts) if _ANY.search(t)]
                counts = np.zeros((n, len(KINDS)), np.int64)
                digest, spans = [nothing] * n, [""] * n
                some = [texts[i] for i in busy]
                bases = [base_spans(t) for t in some]
                for i, text, base, more in zip(busy, some, bases, added_spans(some, bases, field)):
                    for s in base:
                        counts[i, s[0]] += 1
                    digest[i] = hashlib.sha256(written(base).encode()).hexdigest()
                    spans[i] = written(base + more)
                    if redact:
                        texts[i] = masked(text, base + more)
                cols = [part.column(c) for c in kept] + [pa.array(counts[:, j]) for j in range(len(KINDS))] + [pa.array(digest), pa.array(spans)]
                if redact:
                    cols.append(pa.array([t if v.is_valid else None for t, v in zip(texts, part.column(whole))], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return small_batches(docs).select(*kept, F.col("text").alias(whole)).mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans, the first with all it touches."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]
