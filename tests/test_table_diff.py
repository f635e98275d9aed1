"""Lines of texts, payloads and profiles against literal results."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from clauseforge.functions import profiles
from clauseforge.operators import table_diff as D


def slow_lines(left, right):
    cut = lambda t: [y for y in (x.strip() for x in t.replace(" - ", "\n- ").split("\n")) if y]
    a, b, out = cut(left), cut(right), []
    for x in a:
        if x not in b:
            near = [y for y in b if SequenceMatcher(None, x.lower(), y.lower()).ratio() > 0.6]
            out.append(("modified", x, x, near[0]) if near else ("removed", x, None, None))
    return out + [("added", y, None, None) for y in b if y not in a and y not in {o[3] for o in out}]


def test_lines_equal_brute_force(spark):
    rnd, words = random.Random(3), "must shall deliver units within days report logs audit class B field".split()
    text = lambda: "\n".join(rnd.choice(["", "- ", "x - "]) + " ".join(rnd.choices(words, k=rnd.randrange(1, 6))) for _ in range(rnd.randrange(0, 6)))
    pairs = [(text(), text()) for _ in range(200)] + [("", ""), ("a\nb", "a\nb")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: [tuple(c) for c in r.c] for r in df.select("i", D.line_changes(F.col("a"), F.col("b")).alias("c")).collect()}
    assert all(got[i] == slow_lines(a, b) for i, (a, b) in enumerate(pairs))
    assert D.changed_lines(None, "a - b") == [{"type": "added", "text": x, "old": None, "new": None} for x in ("a", "- b")]


def test_rows_without_keys_meet_by_place(spark):
    cols = "table_uid string, row long, key string, texts array<string>"
    old = spark.createDataFrame([("t", 0, "", ["x", "1"]), ("t", 1, "b", ["b", "2"]), ("t", 2, "", ["z", "3"])], cols)
    new = spark.createDataFrame([("t", 0, "b", ["b", "9"]), ("t", 1, "c", ["B ", "2"])], cols)
    got = {(r.row, r.change, r.n_cells) for r in D.row_diffs(old, new).collect()}
    # key b names the first of the old rows with keys, which is in place 0
    assert got == {(0, "modified", 2), (2, "removed", 0)}


def test_payloads_and_profiles(spark):
    rows = [('[{"action":" do "}]',), ("x [1] y",), (None,), ("[]",)]
    df = spark.createDataFrame(rows, "a string")
    got = [r.m for r in df.select(profiles.meaning_payload(F.col("a"), F.lit(1)).alias("m")).collect()]
    assert [x[0].action for x in got if x and x[0].action] == ["do"] and got[2] is None and got[3] is None
    named = spark.createDataFrame([("x/TL81000.pdf", None), ("a.pdf", ["Transient pulses"]), ("a.pdf", ["pulse"]), (None, None)], "n string, h array<string>")
    assert [r.f for r in named.select(profiles.family_profile(F.col("n"), F.col("h")).alias("f")).collect()] == ["tl_81000", "tl_81000", None, None]
