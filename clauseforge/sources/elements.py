"""Chunks of documents that a layout extractor gives as JSON lists of elements."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element types and what becomes of them; other types are dropped.
GROUPS = ("text block",)
KINDS = {"heading": "heading", "paragraph": "clause", "list": "clause", "table": "table", "image": "figure", "caption": "figure", "formula": "figure"}
BOLD_HEADING = 200  # a bold paragraph shorter than this is a heading

CELL = pa.struct([("row", pa.int64()), ("col", pa.int64()), ("row_span", pa.int64()), ("col_span", pa.int64()), ("text", pa.string()), ("is_header", pa.bool_())])
CHUNK = [
    ("ord", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("path", pa.list_(pa.string())), ("page", pa.int64()),
    ("promoted", pa.bool_()), ("bbox", pa.list_(pa.float64())), ("cells", pa.list_(CELL)),
]
SCHEMA = (
    "ord long, kind string, text string, path array<string>, page long, promoted boolean, bbox array<double>, "
    "cells array<struct<row:long,col:long,row_span:long,col_span:long,text:string,is_header:boolean>>"
)


def _many(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _said(e: dict) -> str:
    return str(e.get("content") or "").strip()


def _int(value, otherwise: int | None) -> int | None:
    try:
        return int(value) or otherwise
    except (TypeError, ValueError, OverflowError):
        return otherwise


def _number(value) -> float | None:
    return float(value) if isinstance(value, int | float) else None


def _bold(texts: list[dict]) -> bool:
    return bool(texts) and all("bold" in str(k.get("font") or "").lower() for k in texts)


def _box(e: dict) -> list[float | None] | None:
    """Left, top, right, bottom."""
    box = e.get("bounding box") or e.get("bbox")
    return [_number(box.get(side)) for side in "ltrb"] if isinstance(box, dict) else None


def _items(e: dict) -> str:
    said = (" ".join(filter(None, [_said(item), *map(_said, _many(item.get("kids")))])) for item in _many(e.get("list items")))
    return "\n".join(f"- {x}" for x in said if x)


def _cells(e: dict) -> list[dict]:
    """Cells from zero; those of the first row and wholly bold ones are headers."""
    out = []
    for cell in (c for row in _many(e.get("rows")) for c in _many(row.get("cells"))):
        kids = _many(cell.get("kids"))
        row, col = _int(cell.get("row number"), 1) - 1, _int(cell.get("column number"), 1) - 1
        text = " ".join(_said(k) for k in kids if k.get("content")) or _said(cell)
        spans = {f"{x}_span": _int(cell.get(f"{name} span"), 1) for x, name in (("row", "row"), ("col", "column"))}
        out.append({"row": row, "col": col, **spans, "text": text, "is_header": row == 0 or _bold(kids)})
    return out


def _grid_text(cells: list[dict]) -> str:
    rows: dict[int, list[str]] = {}
    for c in cells:
        if c["text"]:
            rows.setdefault(c["row"], []).append(c["text"])
    return "\n".join(" | ".join(rows[r]) for r in sorted(rows))


def _flat(elements: list[dict]) -> Iterator[dict]:
    """Elements in reading order, groups opened however deep."""
    left = elements[::-1]
    while left:
        e = left.pop()
        if str(e.get("type") or "").lower() in GROUPS:
            left.extend(_many(e.get("kids"))[::-1])
        else:
            yield e


def outline(elements: list[dict]) -> Iterator[dict]:
    """The chunks of one document.  ``path``: the headings above, a heading's own
    included; one closes those of its level and deeper."""
    above: list[tuple[int, str]] = []
    n = 0
    for e in _flat(elements):
        type_ = str(e.get("type") or "").lower()
        kind, text, cells, promoted = KINDS.get(type_), _said(e), None, False
        if type_ == "list":
            text = _items(e)
        elif type_ == "table":
            cells = _cells(e)
            text = _grid_text(cells)
        elif kind == "figure":
            text = text or str(e.get("source") or "")
        elif type_ == "paragraph":
            promoted = 0 < len(text) < BOLD_HEADING and _bold([k for k in _many(e.get("kids")) if k.get("content")])
        if kind is None or not (text or cells):
            continue
        if kind == "heading" or promoted:
            level = _int(e.get("heading level"), above[-1][0] + 1 if promoted and above else 1)
            above = [*(h for h in above if h[0] < level), (level, text)]
            kind = "heading"
        yield {"ord": n, "kind": kind, "text": text, "path": [t for _, t in above], "page": _int(e.get("page number"), None), "promoted": promoted, "bbox": _box(e), "cells": cells}
        n += 1


def element_chunks(docs: DataFrame, doc: str = "doc", elements: str = "elements", batch: int = 4096) -> DataFrame:
    """``(doc, ord, kind, text, path, page, promoted, bbox, cells)`` of documents whose
    JSON is a list of elements, or an object with that list as ``kids``.

    Documents are read where they are, without a shuffle.  No JSON or null: no chunk;
    text that is no JSON: one chunk of kind ``invalid`` with the parser's message.
    Repeated documents give their chunks again."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, ids, rows = [b.schema.field(0), *(pa.field(*c) for c in CHUNK)], [], []

            def made() -> pa.RecordBatch:
                body = pa.RecordBatch.from_pylist(rows, pa.schema(fields[1:]))
                return pa.RecordBatch.from_arrays([pa.array(ids, fields[0].type), *body.columns], schema=pa.schema(fields))

            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    tree = json.loads(text or "[]")
                    found = outline(_many(tree.get("kids") if isinstance(tree, dict) else tree))
                except (ValueError, RecursionError) as error:
                    found = iter([{"ord": 0, "kind": "invalid", "text": str(error), "path": [], "promoted": False}])
                for chunk in found:
                    ids.append(key)
                    rows.append(chunk)
                    if len(rows) == batch:
                        yield made()
                        ids, rows = [], []
            if rows:
                yield made()

    return docs.select(F.col(doc).alias("doc"), F.col(elements).cast("string").alias("elements")).mapInArrow(run, f"doc {kind}, {SCHEMA}")


def chunk_cells(chunks: DataFrame) -> DataFrame:
    """``(doc, ord, row, col, row_span, col_span, text, is_header)``: the tables' cells,
    as the operators on tables take them."""
    return chunks.where("kind = 'table'").select("doc", "ord", F.inline("cells"))
