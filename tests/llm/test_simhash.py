import random

import numpy as np
import xxhash

from clauseforge.llm import simhash as S
from clauseforge.llm.components import connected_components, large_star, small_star

SCHEMA = "doc_id long, text string, component_id string, fp int"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(n=60):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(n):
        base = [rnd.choice(words) for _ in range(200)]
        rows.append(" ".join(base))
        if k % 3 == 0:
            for _ in range(3):
                edited = list(base)
                for _ in range(rnd.choice([1, 2, 6])):
                    edited[rnd.randrange(200)] = rnd.choice(words)
                rows.append(" ".join(edited))
        if k % 10 == 0:
            rows += [" ".join(base), " ".join(base).upper()]
    return [*rows, None, "", "  \n", "one", "one two", "Ä ÄÖ x", "x " * 5000]


def test_fingerprint_equals_brute_force():
    for t in corpus():
        assert S.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)
    long_text = ("a b c d e f " * 9000).encode()
    assert S.fingerprint(long_text) == slow_fingerprint(long_text.decode())


def test_components_equal_brute_force(spark):
    rows = dict(enumerate(corpus()))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows.items()] + [(3, rows[3], "again", 2)], SCHEMA)
    got = S.near_duplicates(df).collect()
    fp = {i: slow_fingerprint(t) for i, t in rows.items()}
    want = components(list(rows), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert len(got) == len(rows) + 1
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", want[i]) for i in rows}


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "z y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in S.near_duplicates(df).collect()) == [(0, 0), (0, 7), (7, 7)]
    none = df.where("false")
    assert S.near_duplicates(none).isEmpty() and S.similar_groups(none).isEmpty()


def test_null_ids_link_others(spark):
    """A row without an id bridges two that have one, and takes their component."""
    one = next(t for t in (f"a b c d e{i} f g h" for i in range(99)) if t)
    fp = S.fingerprint(one.encode())
    rows = [(7, fp), (None, fp ^ 0b11), (9, fp ^ 0b11111), (None, ~fp & (1 << 64) - 1)]
    assert len({f for _, f in rows}) == 4
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    real, S.fingerprints = S.fingerprints, lambda docs, *_: docs
    try:
        got = S.near_duplicates(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    finally:
        S.fingerprints = real
    assert sorted((int(r.fingerprint, 16), r.component_id) for r in got) == sorted(zip((f for _, f in rows), (7, 7, 7, None), strict=True), key=lambda x: x[0])


def test_blocks_find_the_same_links(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 150, np.int64)
    near = np.concatenate([base[:60] ^ (1 << int(k)) for k in rnd.integers(0, 60, 4)])
    near = np.concatenate([near, base[:40] ^ np.int64(0b101010101 << 20)])
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    bits = np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64))
    for rows_per_block, radius in ((8192, 3), (7, 3), (3, 3), (50, 12)):
        want = components(range(len(fps)), lambda a, b, r=radius: bits[a, b] <= r)
        got = {r.node: r.component for r in connected_components(S.near_links(df, radius, rows_per_block)).collect()}
        place = {int(f): i for i, f in enumerate(fps)}
        assert {i: place[got.get(int(f), int(f))] for i, f in enumerate(fps)} == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3)], "a long, b long")
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_a_round_reads_its_edges_four_times(spark):
    edges = spark.createDataFrame([(3, 1), (1, 2), (5, 4), (6, 6)], "a long, b long").localCheckpoint()
    star = small_star(large_star(edges))
    assert star._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 4
    assert sorted(map(tuple, star.collect())) == [(2, 1), (3, 1), (5, 4)]


def test_similar_groups_equal_brute_force(spark):
    rows = dict(enumerate(corpus(40)))
    sets = {i: set(S.shingle_hashes((t or "").encode()).tolist()) for i, t in rows.items()}
    alike = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    want = components(list(rows), alike)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for size in (2000, 3):
        assert {r.doc_id: r.component_id for r in S.similar_groups(df, rows_per_block=size).collect()} == want


def test_similar_groups_beyond_the_radius(spark):
    """Tails, blocks and repeated lines move many bits of a fingerprint, or few."""
    rnd, rows = random.Random(5), []
    fresh = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    for k in range(160):
        base = fresh((60, 200)[k % 2])
        n = len(base) - 4
        cut = n // 10 - 5  # a block of cut words costs cut + 4 shingles a side
        line = fresh(12)
        rows += [base, base + fresh(n // 4 - 1), base[:20] + fresh(cut) + base[20 + cut :]] if cut > 0 else [base, base + fresh(n // 4 - 1)]
        if k % 8 == 0:
            rows += [line * 9 + base, line * 2 + base, line * 9 + fresh(30)]
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    sets = {i: set(S.shingle_hashes(t.encode()).tolist()) for i, t in texts.items()}
    want = components(list(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    far = [(a, b) for a in texts for b in range(a + 1, min(a + 6, len(rows))) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and (S.fingerprint(texts[a].encode()) ^ S.fingerprint(texts[b].encode())).bit_count() > 12]
    assert far
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for size in (2000, 3):
        assert {r.doc_id: r.component_id for r in S.similar_groups(df, rows_per_block=size).collect()} == want


def test_texts_that_share_an_id(spark):
    """Groups are of texts, not of ids; clashing columns and repeated rows."""
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, two), (1, one), (2, two + " end"), (None, one), (3, one.upper()), (4, None), (5, ""), (6, "x " * 200_000)]
    df = spark.createDataFrame([(i, t, 0, "k", 1) for i, t in rows], "doc_id long, text string, kept_id int, kept_key string, rank_ int")
    got = S.first_of_groups(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in got.collect()) == [(0, "a0"), (1, "a0"), (1, "b0"), (4, ""), (6, "x ")]
