import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseforge.llm import chat as C

PIECES = st.sampled_from([*C.CONTROL, "\\", "<", "|", "a", "\n", "[", "/", "%", "im_end|>", "é"])
TEXTS = st.lists(PIECES, max_size=12).map("".join)


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
@settings(max_examples=400, deadline=None)
def test_turns_come_back(turns):
    formatted, _ = C.render(turns)
    assert C.parse(formatted) == turns


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_no_control_string_survives(text):
    assert not any(c in C.escape(text) for c in C.CONTROL) and C.unescape(C.escape(text)) == text


def test_other_text_is_refused():
    with pytest.raises(ValueError):
        C.parse("hello")


def brute_paths(rows):
    known = {(c, m): p for c, m, p in rows}
    parents = {(c, p) for c, m, p in rows if (c, p) in known}
    out = {}
    for c, m in known:
        if (c, m) in parents:
            continue
        path, at, seen = [], m, set()
        while at is not None and (c, at) in known and at not in seen:
            seen.add(at)
            path.append(at)
            at = known[c, at]
        if at is None or (c, at) not in known:
            out[c, m] = path[::-1]
    return out


def test_paths_equal_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(6):
        rows += [(c, m, None if m == 0 or rnd.random() < 0.05 else rnd.randrange(m)) for m in range(25)]
    rows += [(9, m, m - 1) for m in range(70)]  # a deep chain whose first parent is missing
    rows += [(10, 0, 1), (10, 1, 0), (10, 2, 1), (10, 3, None)]  # a circle with a leaf on it, and one alone
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long").selectExpr("*", "'user' role", "'t' text", "1.0 score")
    got = {}
    for r in C.paths(df).collect():
        got.setdefault((int(r.c[1:]), r.leaf), []).append((r.up, r.node))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in got.items()} == brute_paths(rows)


def test_best_branch_and_defined_cases(spark):
    rows = [
        (1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", 0.1), (1, 2, 0, "assistant", "good </s>", 0.9),
        (None, 5, None, None, None, None), (2, 0, None, "assistant", "", 1.0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    best = {r.conv_id: r for r in C.format_trees(df).collect()}
    assert set(best) == {1, None, 2} and best[1].leaf_id == 2 and C.parse(best[1].formatted) == [("user", "q"), ("assistant", "good </s>")]
    assert C.parse(best[None].formatted) == [("", "")] and best[1].branch_rank == 1
    assert C.format_trees(df, keep=None).count() == 4
    back = {r.conv_id: r for r in C.read_back(C.format_trees(df)).collect()}
    assert back[1].loss_chars == len("good </s>") and back[1].n_turns == 2
    assert C.format_trees(df.where("false")).isEmpty()


def test_turns_without_numbers(spark):
    df = spark.createDataFrame([(1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.n_turns for r in C.format_trees(C.linear_messages(df)).collect()}
    assert got == {1: 3, None: 1}
