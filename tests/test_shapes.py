"""Literal values of table structure operators."""

from pyspark.sql import functions as F

from clauseforge.operators import shapes as H


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "table_uid string, row bigint, col int, text string")


def one(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0]["v"]


def words(*x):
    return F.array(*map(F.lit, x)).cast("array<string>")


def test_column_changes(spark):
    v = one(spark, H.column_changes(words("Prüf.Nr", "Limit", "Note"), words("Test.Nr", "Limit", "Extra")))
    assert (v["added"], v["removed"]) == (["Extra"], ["Note"])
    assert [tuple(r) for r in v["renamed"]] == [("Prüf.Nr", "Test.Nr", "TestNumber")]
    v = one(spark, H.column_changes(words(), words("a")))
    assert (v["added"], v["removed"], v["renamed"]) == (["a"], [], [])


def test_structural_changes(spark):
    side = lambda s, split, c, *h: F.struct(F.lit(s).alias("section"), F.lit(split).alias("is_split"), F.lit(c).alias("caption"), words(*h).alias("headers"))
    assert one(spark, H.structural_changes(side("a", False, "c", "x", "y"), side("b", True, "d", "y", "x"))) == ["moved_section", "split_across_pages", "caption_changed", "columns_reordered"]
    assert one(spark, H.structural_changes(side("a", True, None, "x"), side("a", True, None, "x"))) == []


def test_kinds_and_impact(spark):
    n = lambda x: F.lit(x)
    kind = lambda s, st, c, r, m: one(spark, H.diff_type(n(s), words(*st), n(c), n(r), n(m)))
    assert kind(1.0, [], 0, 0, 0) == "identical"
    assert kind(1.0, ["caption_changed", "moved_section"], 0, 0, 0) == "moved"
    assert kind(0.5, ["columns_reordered"], 1, 1, 1) == "column_changed"
    assert kind(0.5, [], 0, 0, 2) == "cell_changed"
    impact = lambda k, st, e, c, r, m, x: one(spark, H.impact(n(k), words(*st), words(*e), n(c), n(r), n(m), n(x)))
    assert impact("renamed", ["caption_changed"], [], 0, 0, 0, 0) == "low"
    assert impact("renamed", ["caption_changed"], ["field_strength"], 0, 0, 0, 0) == "high"
    assert impact("row_changed", [], [], 0, 1, 0, 4) == "medium"
    assert impact("row_changed", [], [], 0, 1, 0, 5) == "high"
    assert impact("column_changed", [], [], 1, 0, 0, 0) == "medium"


def test_signals_names_and_replacement(spark):
    assert one(spark, H.continuation_signals(F.lit("Limits (continued)"), words("x", "Continued"), F.array(F.lit(2), F.lit(3)))) == ["caption_continued_marker", "content_continued_marker", "page_split"]
    assert one(spark, H.continuation_signals(F.lit(None).cast("string"), words(), F.array(F.lit(2)))) == []
    assert one(spark, H.table_name(F.lit("Limits continued (page 2)"), F.lit(7))) == "tbl_limits_007"
    better = lambda conf, now: one(spark, H.replaces(F.lit(conf), words("a", "column_2"), F.lit(2), F.lit(2), words(*now)))
    assert better(0.7, ["column_1"]) and better(0.7, []) and not better(0.69, []) and not better(0.9, ["a"])


def test_generic_key(spark):
    v = one(spark, H.generic_key(F.lit("REQ-12 TC-3 worst case, Step b")))
    assert tuple(v) == ("REQ-12", "TC-3", "worst_case", "step_b")
    assert tuple(one(spark, H.generic_key(F.lit("clause 4.2.1 check")))) == ("4.2.1", "", "", "check")
    assert tuple(one(spark, H.generic_key(F.lit("")))) == ("", "", "", "")


def test_headers_without_spans(spark):
    c = cells(spark, ("t", 0, 0, "A"), ("t", 0, 2, "C"), ("t", 1, 0, "x"), ("t", 1, 1, None))
    assert [tuple(r) for r in H.headers(c).collect()] == [("t", ["a", "column_2", "c"], 1)]


def test_verdicts(spark):
    s = lambda *rows: spark.createDataFrame([("t", r, c, x, p) for r, c, x, p in rows], "table_uid string, row bigint, col int, text string, section string")
    reason = lambda d, **k: H.verdicts(d, **k).collect()[0]["reason"]
    wide = [(r, c, f"w{r}{c}", "Scope") for r in range(3) for c in range(3)]
    assert reason(s(*wide)) is None
    assert reason(s((0, 0, "x", "Scope"))) == "too_small"
    assert reason(s((0, 0, "x", "Scope"), (4, 4, "y", "Scope"))) == "sparse"
    assert reason(s(*[(r, c, "1." if c == 0 else x, p) for r, c, x, p in wide])) == "list"
    assert reason(s((0, 0, "x" * 81, "Scope")), conservative=True) == "sentence_header"
    assert H.verdicts(s().limit(0)).isEmpty()


def test_entities(spark):
    named = spark.createDataFrame([("t", ["f in MHz", "Level (V/m)"])], "table_uid string, headers array<string>")
    p = H.entity_profiles(cells(spark, ("t", 0, 0, "30 bis 230"), ("t", 0, 1, "10"), ("t", 1, 0, "1 GHz"), ("t", 1, 1, "3 V/m")), named)
    assert {(r["row"], r["entity"], r["value"]) for r in p.collect()} == {
        (0, "frequency_range", "30000000-230000000Hz"), (0, "field_strength", "10 V/m"), (1, "frequency", "1000000000.0 Hz"), (1, "field_strength", "3 V/m"),
    }


def test_entity_changes(spark):
    profile = lambda *r: spark.createDataFrame(list(r), "table_uid string, row bigint, entity string, value string")
    old = profile(("t", 0, "frequency_range", "a"), ("t", 0, "level", "1"), ("t", 1, "frequency_range", "b"), ("t", 1, "level", "2"), ("t", 5, "level", "9"))
    new = profile(("t", 0, "frequency_range", "b"), ("t", 0, "level", "3"), ("t", 7, "level", "4"))
    got = {(r["entity"], r["old"], r["new"], r["change"], r["row_old"], r["row_new"]) for r in H.entity_changes(old, new).collect()}
    assert got == {
        ("level", "2", "3", "modified", 1, 0), ("level", None, "4", "added", None, 7),
        ("frequency_range", "a", None, "removed", 0, None), ("level", "1", None, "removed", 0, None), ("level", "9", None, "removed", 5, None),
    }


def test_html_escapes(spark):
    c = cells(spark, ("t", 0, 0, "a<b")).withColumn("col_span", F.lit(2))
    named = spark.createDataFrame([("t", ["x&y"])], "table_uid string, headers array<string>")
    assert H.html(c, named).collect()[0]["html"] == '<table class="canonical-table"><thead><tr><th>x&amp;y</th></tr></thead><tbody><tr><td colspan="2">a&lt;b</td></tr></tbody></table>'


def test_fact_cells(spark):
    rows = [("t", 0, 0, " -12,5 "), ("t", 0, 1, "7"), ("t", 0, 2, None), ("t", 0, 3, "7"), ("t", 1, 0, "3 V/m"), ("t", 1, 1, "x"), ("u", 0, 0, "7")]
    cells = spark.createDataFrame(rows, "table_uid string, row int, col int, text string")
    named = spark.createDataFrame([("t", ["Field strength", "Zzz", "Frequency range"])], "table_uid string, headers array<string>")
    got = {(r["table_uid"], r["row"], r["col"]): (r["semantic_key"], [(f["value"], f["unit"], f["confidence"]) for f in r["facts"]]) for r in H.fact_cells(cells, named).collect()}
    assert got == {
        ("t", 0, 0): ("FieldStrength", [("12.5", "V/m", 0.75)]), ("t", 0, 1): (None, []), ("t", 0, 2): ("FrequencyRange", []), ("t", 0, 3): (None, []),
        ("t", 1, 0): ("FieldStrength", [("3", "V/m", 0.95)]), ("t", 1, 1): (None, []), ("u", 0, 0): (None, []),
    }
