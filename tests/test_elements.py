"""Layout elements to chunks: headings, lists, tables, odd input."""

import json

from clauseforge.sources import elements as E


def chunks(*found):
    return list(E.outline(list(found)))


def test_headings_close_deeper_ones():
    h = lambda level, text: {"type": "heading", "heading level": level, "content": text}
    got = chunks(h(1, "A"), h(3, "B"), h(2, "C"), {"type": "Paragraph", "content": " x "}, h(1, "D"), h("?", "E"))
    assert [c["path"] for c in got] == [["A"], ["A", "B"], ["A", "C"], ["A", "C"], ["D"], ["E"]]
    assert [c["ord"] for c in got] == list(range(6)) and got[3]["text"] == "x"


def test_short_bold_paragraphs_are_headings():
    bold = lambda n, **more: {"type": "paragraph", "content": "b" * n, "kids": [{"content": "b", "font": "Some-BOLD"}], **more}
    got = chunks({"type": "heading", "heading level": 2, "content": "A"}, bold(199), bold(200), bold(3, **{"heading level": 1}))
    assert [(c["kind"], c["promoted"], len(c["path"])) for c in got] == [("heading", False, 1), ("heading", True, 2), ("clause", False, 2), ("heading", True, 1)]


def test_groups_open_in_order_however_deep():
    group = {"type": "paragraph", "content": "deep"}
    for _ in range(3000):
        group = {"type": "text block", "kids": [group]}
    got = chunks({"type": "text block", "kids": [group, {"type": "footer", "content": "no"}, {"type": "formula", "source": "f.png"}]}, {"type": "paragraph", "content": "end"})
    assert [(c["kind"], c["text"]) for c in got] == [("clause", "deep"), ("figure", "f.png"), ("clause", "end")]


def test_lists_and_tables():
    items = [{"content": "a", "kids": [{"content": " b "}, {"content": ""}]}, {"content": " "}, {"kids": [{"content": "c"}]}]
    cell = lambda r, c, text, **more: {"row number": r, "column number": c, "kids": [{"content": text, **more}]}
    rows = [{"cells": [cell(1, 1, "h"), {"row number": 1, "column number": 2, "column span": 2, "content": "w"}]}, {"cells": [cell(2, 1, "x", font="Bold"), cell(2, 2, "y")]}]
    got = chunks({"type": "list", "list items": items}, {"type": "list"}, {"type": "table", "rows": rows, "page number": 4, "bounding box": {"l": 1, "t": 2.5, "r": 3}})
    assert got[0]["text"] == "- a b\n- c" and len(got) == 2
    assert [(c["row"], c["col"], c["col_span"], c["text"], c["is_header"]) for c in got[1]["cells"]] == [(0, 0, 1, "h", True), (0, 1, 2, "w", True), (1, 0, 1, "x", True), (1, 1, 1, "y", False)]
    assert (got[1]["text"], got[1]["page"], got[1]["bbox"]) == ("h | w\nx | y", 4, [1.0, 2.5, 3.0, None])


def test_documents(spark):
    one = json.dumps({"kids": [{"type": "paragraph", "content": "x"}] * 3 + [None, 7, {"type": None}, {"type": "table"}]})
    docs = spark.createDataFrame([(1, one, "k"), (1, one, "k"), (2, None, "k"), (3, "", "k"), (4, "{", "k"), (None, "[]", "k"), (None, one, "k"), (5, "3", "k")], "doc int, elements string, kind string")
    got = sorted((r["doc"] or 0, r["ord"], r["kind"]) for r in E.element_chunks(docs, batch=2).collect())
    clause = lambda d: [(d, n, "clause") for n in range(3)]
    assert got == sorted(clause(0) + clause(1) * 2 + [(4, 0, "invalid")])
    assert E.element_chunks(docs.limit(0)).isEmpty()
