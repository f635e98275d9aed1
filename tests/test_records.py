"""Literal rows of node, record and store operators."""

from pyspark.sql import functions as F

from clauseforge.operators import nodes, records
from clauseforge.sources import stores

NODE = "doc int, section string, page int, ord int, node_type string, text string, n_cols int, has_header boolean, is_list boolean"


def stitched(spark, *rows):
    d = spark.createDataFrame([(1, *r) for r in rows], NODE)
    return [(r["page"], r["text"], r["n"]) for r in nodes.stitched(d).orderBy("section", "page", "ord").collect()]


def clause(page, order, text, section="s", listed=False):
    return (section, page, order, "clause", text, None, None, listed)


def test_stitch_spans_two_pages_at_most(spark):
    got = stitched(spark, clause(1, 1, "One"), clause(2, 2, "two"), clause(3, 3, "three"), clause(4, 4, "four"))
    assert got == [(1, "One\n\ntwo", 2), (3, "three\n\nfour", 2)]


def test_stitch_takes_in_all_of_the_next_page(spark):
    got = stitched(spark, clause(1, 1, "One"), clause(2, 2, "two"), clause(2, 3, "three"), clause(2, 4, "Four"), clause(2, 5, "five"))
    assert got == [(1, "One\n\ntwo\n\nthree", 3), (2, "Four", 1), (2, "five", 1)]


def test_stitch_breaks(spark):
    assert len(stitched(spark, clause(1, 1, "One."), clause(2, 2, "two"))) == 2
    assert len(stitched(spark, clause(1, 1, "One"), clause(2, 2, "Two"))) == 2
    assert len(stitched(spark, clause(1, 1, "One"), clause(3, 2, "two"))) == 2
    assert len(stitched(spark, clause(1, 1, "One"), clause(2, 2, "two", section="t"))) == 2
    assert len(stitched(spark, clause(1, 1, "One."), clause(2, 2, "Two", listed=True))) == 1
    assert len(stitched(spark, clause(1, 1, None), clause(2, 2, "two"))) == 2


def test_stitch_tables(spark):
    t = lambda page, order, cols, head: ("s", page, order, "table", f"t{order}", cols, head, None)
    assert len(stitched(spark, t(1, 1, 3, True), t(2, 2, 4, False))) == 1
    assert len(stitched(spark, t(1, 1, 3, True), t(2, 2, 5, False))) == 2
    assert len(stitched(spark, t(1, 1, 3, True), t(2, 2, 3, True))) == 2


def test_page_ranges(spark):
    d = spark.createDataFrame([(1, 3, 0.1, 9), (1, 5, 0.2, 9), (1, 9, 0.0, 9), (1, 7, 0.9, 9), (2, 1, 0.1, 1)], "doc int, page int, density double, pages int")
    assert {tuple(r) for r in nodes.page_ranges(d).collect()} == {(1, 2, 6), (1, 8, 9), (2, 1, 1)}


def test_blocks(spark):
    long = " ".join(f"Sentence number {i} ends here." for i in range(100))
    got = spark.range(1).select(nodes.blocks(F.lit("a\nb\n\n c ")).alias("x"), nodes.blocks(F.lit(long)).alias("y"), nodes.blocks(F.lit(None).cast("string")).alias("z")).collect()[0]
    assert got["x"] == ["a b", "c"] and got["z"] == []
    assert " ".join(got["y"]) == long and all(len(b) <= 900 for b in got["y"]) and len(got["y"]) > 3


def test_consolidated(spark):
    words = "a b c d e f g h i j"
    rows = [
        ("s", "REMOVED", words), ("s", "ADDED", words + " k"), ("Tabelle 3 old", "REMOVED", "p q r s"), ("Tabelle 3 new", "ADDED", "p q x y"),
        ("t", "REMOVED", "one two"), ("t", "ADDED", "three four"), ("u", "REMOVED", "alone"),
    ]
    d = spark.createDataFrame(rows, "section string, change_type string, text string")
    got = {r["section"]: r["decision"] for r in records.consolidated(d).collect()}
    assert got == {"s": "dropped", "Tabelle 3 new": "modified", "t": "kept", "u": "kept"}


def test_combined(spark):
    d = spark.createDataFrame([(1, 2, 1, "b", "x", "note"), (1, 1, 5, "a", "y", "clause"), (1, 3, 0, None, "z", "clause")], "g int, page int, ord int, text string, node string, node_type string")
    assert [tuple(r) for r in records.combined(d, "g").collect()] == [(1, "paragraph", "a\n\nb", "y,x,z")]


def test_details_and_kept(spark):
    s = lambda *x: [F.lit(v).cast("string") for v in x]
    d = lambda *x: spark.range(1).select(records.details(*s(*x)).alias("d")).collect()[0]["d"]
    assert [r["type"] for r in d("ADDED", "same", None, "new", None, "s")] == ["added"]
    assert [r["location"] for r in d("MODIFIED", "moved", "a", "b", "s", "t")] == ["section", None]
    assert d("MODIFIED", "split", "a", "b", "s", "s")[0]["text"] == "Node split into multiple nodes"
    assert d("MODIFIED", "same", "a", "a", "s", "s") == []
    k = lambda section, change, structural, a, b: spark.range(1).select(records.is_kept(*s(section, change), F.lit(structural), *s(a, b), F.lit(True)).alias("k")).collect()[0]["k"]
    assert k("Scope", "MODIFIED", False, "a", "b") and not k("Scope", "MODIFIED", False, "A  b", "a b") and k("Scope", "MODIFIED", True, "a", "a")
    assert not k("Annex A", "ADDED", False, None, "b") and k("Annex A, Tabelle 2", "ADDED", False, None, "b")


def test_sample_is_stable_and_bounded(spark):
    d = spark.range(100).select(F.lit("p").alias("pair"), F.col("id").cast("string").alias("change_id"))
    one, two = (sorted(r["change_id"] for r in records.sample(d.repartition(n)).collect()) for n in (1, 7))
    assert one == two and len(one) == 10


def test_stored_nodes(spark, tmp_path):
    path = str(tmp_path / "nodes")
    rows = lambda doc, text: spark.createDataFrame([(doc, 2, "b", text), (doc, 1, "a", text)], "doc int, ord int, node string, text string")
    stores.save_nodes(rows(1, "old").unionByName(rows(2, "other")), path)
    stores.save_nodes(rows(1, "new"), path)
    assert [(r["node"], r["text"]) for r in stores.load_nodes(spark, path, 1).collect()] == [("a", "new"), ("b", "new")]
    assert stores.load_nodes(spark, path, 2).count() == 2
    assert stores.delete(spark.read.parquet(path), spark.createDataFrame([(2,)], "doc int")).count() == 2


def test_documents_states_and_cache(spark):
    m = spark.createDataFrame(
        [("/u/a/metadata.json", "1", "n", "2024"), ("/u/_cache/metadata.json", "2", "n", "2024"), ("/u/b/metadata.json", None, "n", "2024"), ("/u/c/metadata.json", "3", "n", "2025")],
        "path string, id string, name string, upload_date string",
    )
    assert [r["id"] for r in stores.documents(m).collect()] == ["3", "1"]
    show = lambda c: spark.range(1).select(c.alias("v")).collect()[0]["v"]
    assert [show(stores.job_state(F.lit(s).cast("string"))) for s in (None, "retry", "SUCCESS", "REVOKED")] == ["queued", "running", "finished", "failed"]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert show(stores.is_fresh(F.lit("2024-01-01T00:00:00Z"), now)) and not show(stores.is_fresh(F.lit("2023-12-31T23:59:59Z"), now))
    assert show(stores.is_fresh(F.lit("no time"), now)) and show(stores.is_fresh(F.lit("2000-01-01T00:00:00Z"), now, 0))


def test_citations(spark):
    r = spark.createDataFrame([("a", "own"), ("b", "own")], "node string, section string")
    g = spark.createDataFrame([("a", "graph", 4)], "node string, section string, page int")
    assert {(x["node"], x["section"], x["page"]) for x in stores.citations(r, g).collect()} == {("a", "graph", 4), ("b", "own", None)}


def test_prepared_drops_noise(spark):
    d = spark.createDataFrame(
        [(1, 0, "s", 1, "clause", "12"), (1, 1, "s", 1, "clause", "Privileged access should use"), (1, 2, "s", 1, "clause", "mfa when remote."), (1, 3, "Contents", 1, "clause", "Contents of all the sections")],
        "doc int, ord int, section string, page int, kind string, text string",
    )
    assert [r["text"] for r in nodes.prepared(d).collect()] == ["Privileged access should use mfa when remote."]


def test_key_differences(spark):
    rows = [
        (1, "MODIFIED", None, "1", "1", "a", "b"), (2, "MODIFIED", "Legend", "1", "1", "a", "b"), (3, "MODIFIED", "Legend / Tabelle 4", "1", "1", "a", "b"),
        (4, "MODIFIED", None, "1", "1", "A  b", "a b"), (5, "REMOVED", None, "2", None, "a", None), (6, "ADDED", None, None, "3", None, "a"), (7, "ADDED", None, None, "1", None, "a"),
        (8, "MODIFIED", None, "2", "3", "x", "y"), (9, "MODIFIED", None, "2", "4", "x", "y"), (10, "MODIFIED", None, None, None, None, None),
    ]
    diffs = spark.createDataFrame(rows, "node int, change_type string, section string, l_section string, r_section string, l_text string, r_text string")
    unchanged = spark.createDataFrame([("2", "3"), ("2", "3")], "l_section string, r_section string")
    got = records.key_differences(diffs, unchanged)
    assert got.columns == diffs.columns and sorted(r["node"] for r in got.collect()) == [1, 3, 7, 9, 10]
    assert records.key_differences(diffs, unchanged.limit(0)).count() == 8 and records.key_differences(diffs.limit(0), unchanged).isEmpty()


def test_folded_reports(spark):
    rows = [("a", 1, "diff_start", None, None), ("a", 2, "diff_complete", False, True), ("a", 3, "done", None, None), ("b", 1, "diff_complete", True, True), ("b", 2, "diff_complete", None, None)]
    found = records.folded(spark.createDataFrame(rows, "pair string, seq int, type string, skipped boolean, requires_review boolean"))
    assert sorted(map(tuple, found.collect())) == [("a", True, 1, 0, True, 3), ("b", False, 2, 1, False, 2)]
