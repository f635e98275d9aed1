"""Queries of documents given as lists of layout elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.plans.catalog import query
from clauseforge.sources import elements


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for every forty parts, an element for each, its type by the key."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, name, brand, type_, size = (F.col(f"p_{c}") for c in ("partkey", "name", "brand", "type", "size"))

    def made(kind: str, **fields: Column) -> Column:
        named = [v.alias(n.replace("_", " ")) for n, v in fields.items()]
        return F.to_json(F.struct(F.lit(kind).alias("type"), (k % 9 + 1).alias("page number"), *named))

    said = lambda c, **more: F.struct(c.alias("content"), *[v.alias(n) for n, v in more.items()])
    cell = lambda r, c, text: F.struct(F.lit(r).alias("row number"), F.lit(c).alias("column number"), F.array(said(text)).alias("kids"))
    row = lambda *cells: F.struct(F.array(*cells).alias("cells"))
    item = lambda c, *kids: F.struct(c.alias("content"), F.array(*map(said, kids)).alias("kids"))
    inner = F.struct(F.lit("paragraph").alias("type"), type_.alias("content"))
    cases = {
        0: made("heading", content=name, heading_level=1 + size % 3),
        1: made("header", content=name),
        2: made("list", list_items=F.array(item(name, brand), item(F.lit(" "), F.lit("")), item(type_, F.lit("")))),
        3: made("text block", kids=F.array(F.struct(F.lit("text block").alias("type"), F.array(inner).alias("kids")))),
        4: made("paragraph", content=name, heading_level=F.lit(3), kids=F.array(said(name, font=F.lit("Arial-Bold")))),
        5: made("table", rows=F.array(row(cell(1, 1, name), cell(1, 2, brand)), row(cell(2, 1, size.cast("string")), cell(2, 2, type_)))),
        6: made("caption", content=name),
        7: made("paragraph", content=F.lit("  ")),
    }
    one = made("paragraph", content=F.concat(name, F.lit(" "), brand))
    for t, value in cases.items():
        one = F.when(k % 10 == t, value).otherwise(one)
    parts = p.select(F.floor(k / 40).cast("long").alias("doc"), F.struct(k.alias("k"), one.alias("e")).alias("e"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["e"]), ",")
    return parts.groupBy("doc").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("elements"))


_ELEMENTS = (
    "SELECT p_partkey AS k, p_partkey // 40 AS doc, p_partkey % 10 AS t, p_name, p_brand, p_type, p_size, CASE p_partkey % 10 WHEN 0 THEN 1 + p_size % 3 WHEN 4 THEN 3 END AS level FROM part"
)
_ABOVE = ", ".join(
    f"max(CASE WHEN level = {n} THEN k END) OVER w AS a{n}, last_value(CASE WHEN level = {n} THEN p_name END IGNORE NULLS) OVER w AS n{n}" for n in (1, 2, 3)
)
_PATH = "concat_ws(' > ', n1, CASE WHEN a2 > coalesce(a1, -1) THEN n2 END, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN n3 END)"
_CHUNKS = f"SELECT *, {_PATH} AS path FROM (SELECT *, {_ABOVE} FROM ({_ELEMENTS}) WINDOW w AS (PARTITION BY doc ORDER BY k)) WHERE t NOT IN (1, 7)"


@query(
    "element_chunks",
    "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k) - 1 AS ord, CASE WHEN t IN (0, 4) THEN 'heading' WHEN t = 5 THEN 'table' WHEN t = 6 THEN 'figure' ELSE 'clause' END AS kind, "
    "CASE t WHEN 2 THEN '- ' || p_name || ' ' || p_brand || chr(10) || '- ' || p_type WHEN 3 THEN p_type WHEN 5 THEN p_name || ' | ' || p_brand || chr(10) || p_size || ' | ' || p_type "
    "WHEN 8 THEN p_name || ' ' || p_brand WHEN 9 THEN p_name || ' ' || p_brand ELSE p_name END AS text, "
    f"path, CASE WHEN t <> 3 THEN k % 9 + 1 END AS page, t = 4 AS promoted FROM ({_CHUNKS})",
)
def element_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements.element_chunks(_documents(spark, sf_dir))
    return found.select("doc", "ord", "kind", "text", F.array_join("path", " > ").alias("path"), "page", "promoted")


@query(
    "element_cells",
    "SELECT k // 40 AS doc, r AS row, c AS col, r = 0 AS is_header, CASE 2 * r + c WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE p_type END AS text, count(*) AS n "
    f"FROM ({_ELEMENTS}), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(r, c) WHERE t = 5 GROUP BY ALL",
)
def element_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = elements.chunk_cells(elements.element_chunks(_documents(spark, sf_dir)))
    return cells.groupBy("doc", "row", "col", "is_header", "text").agg(F.count("*").alias("n"))
