import time
from math import e, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseforge.llm import ann
from clauseforge.llm import html_extract
from clauseforge.llm.html_extract import extract, main_text

PAGE = """<html><head><title>T</title><script>var a="<p>x</p>";</script><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><aside class=sidebar>Links</aside>
<main><article><h1>A &amp; B</h1><p>First   paragraph with
 enough words to be the text.<p>Second, with <b>bold</b> and &eacute;.<ul><li>one<li>two</ul></article>
<section class="comments"><p>Nice post, I liked it a lot and say so at length, again and again.</p></section></main>
<form><input name=q><button>Go</button></form><footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "A & B\nFirst paragraph with enough words to be the text.\nSecond, with bold and é.\none\ntwo"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<nav>menu</nav>", ""), ("<body><div><p>x y z</p></div></body>", "x y z"),
        ("<!-- c --><p>a &lt; b</p>", "a < b"), ("<p>un<closed", "un<closed"), ("<script>x", ""), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_cases(html, text):
    assert main_text(html) == text


def test_pages_without_article():
    body = "".join(f"<p>Paragraph {i} has a fair number of words, so its density is high.</p>" for i in range(5))
    html = f"<body><div class=menu><a href=1>a</a><a href=2>b</a></div><div id=content><h2>Head</h2>{body}</div><div class=footer>imprint</div></body>"
    assert main_text(html) == "Head\n" + "\n".join(f"Paragraph {i} has a fair number of words, so its density is high." for i in range(5))


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, 3)], "page_id long, url string, html string, text int")
    got = extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(main_text(PAGE)), len(main_text(PAGE))] and extract(df.where("false")).isEmpty()


def slow_measure(node):
    """Characters, tags, link characters and link tags of a node, by recursion."""
    chars = tags = link_chars = link_tags = 0
    for x in node.parts:
        if isinstance(x, html_extract.Node):
            c, t, lc, lt = slow_measure(x)
            if not x.drop:
                chars, tags = chars + c, tags + 1 + t
            link_chars += c if x.tag == "a" else lc
            link_tags += (x.tag == "a") + lt
        else:
            chars += len(" ".join(html_extract.unescape(x).split()))
    return chars, tags, link_chars, link_tags


def test_densities_equal_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(200).collect()]
    for html in [PAGE, *filter(None, pages)]:
        root = html_extract.parse(html)
        order = html_extract._measure(root)
        c, _, lc, _ = slow_measure(root)
        share = lc / max(c + lc, 1)
        want = {}
        for n in order:
            c, t, lc, lt = slow_measure(n)
            lc = min(lc, c)
            if c and not n.drop:
                base = log(log(c / max(c - lc, 1) * lc + share * c + e)) if log(c / max(c - lc, 1) * lc + share * c + e) > 0 else 0
                want[id(n)] = c / max(t, 1) * log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / max(base, 0.1)
        assert all(n.density == pytest.approx(want.get(id(n), 0.0)) for n in order)
        assert all(n.total == pytest.approx(sum(want.get(id(x), 0.0) for x in n.parts if not isinstance(x, str))) for n in order)


def test_density_decides():
    """What stands beside the densest subtree, and a container in doubt, stay if dense."""
    long, short = "One sentence of the text that goes on for a good while. " * 4, "A word."
    main = f"<div id=m>{'<p>' + long + '</p>'}{'<p>' + long + '</p>'}</div>"
    for beside, kept in ((long * 2, True), (short, False)):
        for box in (f"<div>{beside}</div>", f"<div class=newsletter>{beside}</div>"):
            assert (beside.split()[0] in main_text(f"<body>{main}{box}</body>").split("\n")[-1].split()[0:1] and len(main_text(f"<body>{main}{box}</body>").split("\n")) == 3) == kept
        inside = f"<body><article><p>{long}</p><div class=search>{beside}</div><p>{long}</p></article></body>"
        assert (len(main_text(inside).split("\n")) == 3) == kept


def test_article_keeps_its_own():
    html = (
        "<body><nav>menu</nav><article><h1>T</h1><p>Intro text of the article.</p><p id=notice>A notice to readers.</p><div class=search><p>We search for things in text.</p></div>"
        "<div class=related-work><p>Others did this as well.</p></div><div class=ad>Buy this now, it is the best there is</div><p>Of.</p><section class=comments><p>Nice article, says a reader.</p></section></article>"
        "<div class=ad>Buy that</div><footer>f</footer></body>"
    )
    assert main_text(html) == "T\nIntro text of the article.\nA notice to readers.\nWe search for things in text.\nOthers did this as well.\nOf."


@pytest.mark.parametrize("part", ["<font>{}<p>x</b>", "<font><p></p>", "<li><font>", "<td><i></b>", "<a \"<a ", "<a <a ", "<div>", "<p><b>"])
def test_time_follows_length(part):
    n = 5_000_000 // 16
    began = time.time()
    main_text((part * (n // len(part) + 1))[:n])
    assert time.time() - began < 5


def test_traversal_is_in_order():
    rnd = np.random.default_rng(2)
    a, b = rnd.random(7), rnd.random(5)
    pairs = list(ann.traverse(a, b))
    assert len(set(pairs)) == 35
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums)


def brute(ids, x, q, k):
    out = {}
    for i in np.flatnonzero(q):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, ids % 20 == 0, 20)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, slab=200, block=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    at = {int(i): k for k, i in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(np.isclose(s, x[at[q]] @ x[at[v]], atol=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want[q]))
    assert hits / (20 * len(want)) >= 0.9
    full = ann.search(df, F.col("vec_id") % 20 == 0, share=1.0)
    exact = {}
    for r in full.orderBy("query_id", "rank").collect():
        exact.setdefault(r.query_id, []).append(r.vec_id)
    assert exact == want


def directions(rnd, n):
    x = rnd.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["even", "clustered", "varied", "lognormal", "copies"])
def test_recall_on_other_vectors(spark, kind):
    """Norms that vary, clusters and thousands of copies; slabs and blocks of few rows."""
    rnd, n = np.random.default_rng(4), 4000
    x = directions(rnd, n)
    if kind == "clustered":
        x = directions(rnd, 80)[rnd.integers(0, 80, n)] + 0.05 * rnd.normal(size=(n, 16))
    elif kind == "varied":
        x *= rnd.uniform(0.5, 1.5, (n, 1))
    elif kind == "lognormal":
        x *= np.exp(rnd.normal(size=(n, 1)))
    elif kind == "copies":
        x[n // 3 :] = x[0]
    x, ids = x.astype("f4").astype(float), np.arange(n)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    want = brute(ids, x, ids % 20 == 0, 20)
    for share in (None, 1.0):
        got = {}
        for r in ann.search(df, F.col("vec_id") % 20 == 0, share=share, slab=500, block=60).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        hits = sum(len({v for _, v in got[q]} & set(want[q])) for q in want)
        assert hits >= 0.9 * 20 * len(want)
        if share == 1.0:
            assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == want


def test_slabs_hold_every_cell():
    sizes = np.array([3, 0, 50, 4, 4, 0, 900, 2, 0, 120])
    first, parts, starts = ann.deal(sizes, 10)
    ends = np.maximum(np.r_[starts[1:], len(sizes)], starts + 1)
    for c, n in enumerate(sizes.tolist()):
        assert all(starts[s] <= c < ends[s] for s in range(first[c], first[c] + parts[c])) and parts[c] == max(1, -(-n // 10))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, []), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.search(df.where("false"), F.lit(True)).isEmpty() and ann.search(df.where("vec_id = 0"), F.lit(True)).isEmpty()
