"""Search by words and vectors against brute force."""

import math
import re
from collections import Counter

import pytest

from clauseforge.operators import hybrid

DOCS = [
    (1, "The valve shall close within 3 s. Valve!"),
    (2, "the pump may close"),
    (3, "THE PUMP MAY CLOSE"),  # a copy: ties go to the smaller item
    (4, "nothing of that"),
    (5, None),  # found by its vector alone
    (6, "größe über alles; ĳ İvalve"),
    (7, ""),
    (8, "the the the the the the the the valve pump"),
    (9, "the pump may close"),
    (10, "valve"),
    (10, "no more than this"),  # the same item again: the better counts
    (None, "valve pump close"),
    (11, "words that no query asks for"),
    (12, "pump"),
    (13, "pump valve"),
]
QUERIES = [(1, "valve close valve"), (2, "the pump"), (4, None), (6, "größe"), (7, "pump"), (7, "valve"), (30, "zebra"), (31, "close the"), (None, "valve"), (14, "")]
VECTORS = [
    (1, [1.0, 0.0, 0.5]), (2, [0.2, 0.9, 0.1]), (3, [0.2, 0.9, 0.1]), (4, [0.1, 1.0, 0.0]), (5, [0.9, 0.1, 0.5]), (6, [0.0, 0.0, 0.0]), (7, [0.5, 0.5]),
    (8, [1.0, float("nan"), 0.0]), (9, [1.0, None, 0.0]), (10, [-1.0, 0.0, 0.0]), (12, [3.0, 4.0]), (11, None), (13, [float("inf"), 0.0, 1.0]), (14, [0.0, 1.0, 1.0]), (31, [5.0, 5.0, 5.0]),
    (1, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]),
]


def words(text):
    return re.findall("[a-z0-9äöüßéèêçàâñóíáú]+", (text or "").lower())


def slow(docs, queries, vectors, k):
    """All pairs."""
    usable = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    vector = {i: min(v for j, v in usable if j == i) for i, _ in usable}
    mean = sum(len(words(t)) for _, t in docs if t is not None) / sum(t is not None for _, t in docs)
    df = Counter(w for _, t in docs for w in set(words(t)))
    out = []
    for query in dict.fromkeys(q for q, _ in queries):
        asked = [w for q, t in queries if q == query for w in set(words(t))]
        s, d = {}, {}
        for n, (item, text) in enumerate(docs):
            tf = Counter(words(text))
            if any(w in tf for w in asked):
                s[n] = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * tf.total() / mean)) for w in asked if w in tf)
            a, b = vector.get(query), vector.get(item)
            if a and b and len(a) == len(b):
                d[n] = math.sumprod(a, b) / math.sqrt(math.sumprod(a, a)) / math.sqrt(math.sumprod(b, b))

        def scaled(x, n):
            low, high = min(x.values(), default=0), max(x.values(), default=0)
            return 0.0 if n not in x else (x[n] - low) / (high - low) if high > low else 1.0

        best = {}
        for n in s | d:
            best[docs[n][0]] = max(best.get(docs[n][0], 0.0), 0.5 * scaled(d, n) + 0.5 * scaled(s, n))
        order = sorted(best, key=lambda i: (-round(best[i], 9), i is not None, i))
        out += [(query, i, best[i], p + 1) for p, i in enumerate(order[:k])]
    return out


def found(spark, docs, queries, vectors, k, kind="long"):
    frames = [spark.createDataFrame(rows, form) for rows, form in ((docs, f"item {kind}, text string"), (queries, f"query {kind}, text string"), (vectors, f"id {kind}, embedding array<float>"))]
    return [tuple(r) for r in hybrid.hybrid_top_k(*frames, k).collect()]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0], r[3])
    assert [(q, i, p) for q, i, _, p in sorted(got, key=key)] == [(q, i, p) for q, i, _, p in sorted(want, key=key)]
    assert [r[2] for r in sorted(got, key=key)] == pytest.approx([r[2] for r in sorted(want, key=key)], abs=1e-6)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_equals_brute_force(spark, k):
    got = found(spark, DOCS, QUERIES, VECTORS, k)
    same(got, slow(DOCS, QUERIES, VECTORS, k))
    if k == 3:
        assert (1, 5) in {r[:2] for r in got}  # shares no word with the query
        assert (30, 1) not in {r[:2] for r in got}


def test_slices_and_blocks(spark, monkeypatch):
    want = slow(DOCS, QUERIES, VECTORS, 4)
    for slices, block, postings in ((1, 1, 1), (2, 3, 4), (512, 2, 2)):
        monkeypatch.setattr(hybrid, "SLICE", slices)
        monkeypatch.setattr(hybrid, "BLOCK", block)
        monkeypatch.setattr(hybrid, "POSTINGS", postings)
        same(found(spark, DOCS, QUERIES, VECTORS, 4), want)


def test_names_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(hybrid, "LONG", 5)
    named = lambda rows: [(None if i is None else f"n{i:02}", x) for i, x in rows]
    same(found(spark, named(DOCS), named(QUERIES), named(VECTORS), 3, "string"), slow(named(DOCS), named(QUERIES), named(VECTORS), 3))


def test_many_copies(spark):
    """More copies than a slice holds, the smallest item last."""
    docs = [(i, "the pump") for i in range(1500, 0, -1)] + [(2000, "pump of another kind")]
    got = found(spark, docs, [(1, "pump"), (2, "the")], [], 3)
    same(got, slow(docs, [(1, "pump"), (2, "the")], [], 3))
    assert [r[1] for r in sorted(got) if r[0] == 2] == [1, 2, 3]


def test_nothing_to_find(spark):
    assert found(spark, DOCS, [], VECTORS, 3) == found(spark, [], QUERIES, VECTORS, 3) == []
    assert found(spark, DOCS, [(90, "zebra"), (91, None)], [], 3) == []
