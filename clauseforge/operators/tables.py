"""Tables as long rows of cells ``(table_uid, row, col, text)``: keys, projections
and differences of two versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import text as T

CELL = ["table_uid", "row", "col"]


def rows(cells: DataFrame) -> DataFrame:
    """``(table_uid, row, texts array)``, cells in the order of their columns."""
    packed = F.array_sort(F.collect_list(F.struct("col", "text")))
    return cells.groupBy("table_uid", "row").agg(F.transform(packed, lambda x: x["text"]).alias("texts"))


def row_key(texts: Column) -> Column:
    """The first two texts that are not empty, in lower case."""
    plain = F.filter(F.transform(texts, lambda x: F.lower(F.trim(T.blank(x)))), lambda x: x != "")
    return F.array_join(F.slice(plain, 1, 2), " | ")


def fingerprint(texts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(texts, lambda x: T.normalize(x)), " | "), 256)


def projection(cells: DataFrame, headers: list[str], most: int = 50) -> DataFrame:
    """``(table_uid, projection)``: the columns' names, then "name: text" of each of
    the first ``most`` rows."""
    names = F.array(*map(F.lit, headers))
    said = F.transform(F.col("texts"), lambda x, i: F.concat(F.get(names, i), F.lit(": "), x))
    numbered = rows(cells).withColumn("n", F.row_number().over(W.partitionBy("table_uid").orderBy("row"))).where(F.col("n") <= most)
    lines = F.array_sort(F.collect_list(F.struct("n", F.array_join(said, " ; ").alias("line"))))
    head = F.lit("columns: " + ", ".join(headers))
    return numbered.groupBy("table_uid").agg(F.concat_ws("\n", head, F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("projection"))


def markdown_rows(cells: DataFrame) -> DataFrame:
    """``(table_uid, row, line)``: each row as a line of a Markdown table."""
    cell = lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))
    return rows(cells).select("table_uid", "row", F.concat(F.lit("| "), F.array_join(F.transform("texts", cell), " | "), F.lit(" |")).alias("line"))


def requirement_key(c: Column) -> Column:
    return F.regexp_extract(F.upper(T.blank(c)), r"\b((?:REQ|R|TC)[-_ ]?\d+)\b", 1)


def keyed(cells: DataFrame) -> DataFrame:
    """``(table_uid, key, texts)`` of rows with a requirement key."""
    return rows(cells).select("table_uid", requirement_key(F.array_join("texts", " ")).alias("key"), "texts").where("key <> ''")


def row_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(table_uid, key, change)``: rows by key that were added, removed or
    modified."""
    a = keyed(left).select("table_uid", "key", F.array_join("texts", " ").alias("l"))
    b = keyed(right).select("table_uid", "key", F.array_join("texts", " ").alias("r"))
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(T.normalize(F.col("l")) != T.normalize(F.col("r")), "modified")
    return a.join(b, ["table_uid", "key"], "full").select("table_uid", "key", change.alias("change")).where("change is not null")


def _addressed(cells: DataFrame) -> DataFrame:
    key = F.max(F.when(F.col("col") == 0, requirement_key(F.col("text")))).over(W.partitionBy("table_uid", "row"))
    return cells.withColumn("key", F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("#"), F.col("row").cast("string"))))


def cell_diffs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(table_uid, key, col, change, old, new)`` of cells that differ but for white
    space and case; rows meet by key, without one by position."""
    a = _addressed(left).select("table_uid", "key", "col", F.col("text").alias("old"))
    b = _addressed(right).select("table_uid", "key", "col", F.col("text").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(T.normalize(F.col("old")) != T.normalize(F.col("new")), "modified")
    return a.join(b, ["table_uid", "key", "col"], "full").withColumn("change", change).where("change is not null")


def table_diffs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(table_uid, n_added, n_removed, n_modified, similarity, diff_type,
    impact)``: similarity is twice the equal cells over all cells."""
    d = cell_diffs(left, right).groupBy("table_uid").agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in ("added", "removed", "modified")])
    n = left.groupBy("table_uid").agg(F.count("*").alias("ln")).join(right.groupBy("table_uid").agg(F.count("*").alias("rn")), "table_uid", "full")
    counts = n.join(d, "table_uid", "left").na.fill(0)
    equal = F.col("ln") - F.col("n_removed") - F.col("n_modified")
    similarity = F.round(2.0 * equal / F.greatest(F.col("ln") + F.col("rn"), F.lit(1)), 6)
    changed = F.col("n_added") + F.col("n_removed")
    kind = F.when(similarity > 0.99, "identical").when(changed > 0, "row_changed").otherwise("cell_changed")
    impact = F.when(F.col("n_modified") > 0, "high").when(changed > 0, "medium").otherwise("low")
    return counts.select("table_uid", "n_added", "n_removed", "n_modified", similarity.alias("similarity"), kind.alias("diff_type"), impact.alias("impact"))


def bag_jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(table_uid, jaccard, meaning)`` of the sets of cell texts."""
    bag = lambda d, n: d.groupBy("table_uid").agg(F.collect_set(T.normalize(F.col("text"))).alias(n))
    j = F.round(T.jaccard(F.col("a"), F.col("b")), 6)
    both = bag(left, "a").join(bag(right, "b"), "table_uid").select("table_uid", j.alias("jaccard"))
    return both.withColumn("meaning", F.when(F.col("jaccard") >= 0.90, "unchanged").otherwise("modified"))


def span_grid(cells: DataFrame) -> DataFrame:
    """Cells with row_span and col_span, one row a place; of places that two cover
    the later cell's text stands."""
    down = F.explode(F.sequence(F.col("row"), F.col("row") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)) - 1))
    across = F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest(F.coalesce("col_span", F.lit(1)), F.lit(1)) - 1))
    placed = cells.select("table_uid", F.struct("row", "col").alias("source"), "text", down.alias("r"), "col", "col_span").select("table_uid", "source", "text", "r", across.alias("c"))
    return placed.groupBy("table_uid", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.max_by("text", "source").alias("text"))


def page_split_islands(tables: DataFrame) -> DataFrame:
    """``(doc, table_uid, page_from, page_to, island)``: tables that continue the one
    before (next page, same caption and columns) share an island number."""
    w = W.partitionBy("doc").orderBy("page_from", "table_uid")
    goes_on = (
        (F.col("page_from") == F.lag("page_to").over(w) + 1) & (F.col("caption") == F.lag("caption").over(w)) & (F.col("n_cols") == F.lag("n_cols").over(w))
    )
    begun = tables.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return begun.withColumn("island", F.sum("begins").over(w)).drop("begins")


def continuation_score(a: str = "a", b: str = "b") -> Column:
    """Likelihood that candidate b continues a: 0 where the columns differ; caption
    .20, headers .35, alignment .10, repeated header .10, adjacency .10, section .15."""
    c = lambda s, n: F.col(f"{s}.{n}")
    caption = F.when((c(a, "caption") != "") & (c(a, "caption") == c(b, "caption")), 1.0).when((c(a, "caption") == "") | (c(b, "caption") == ""), 0.0).otherwise(0.0)
    header = T.jaccard(c(a, "headers"), c(b, "headers"))
    offset = F.abs(c(a, "x0") - c(b, "x0"))
    align = F.greatest(F.lit(0.0), 1.0 - offset / 100.0)
    repeat = F.when(c(a, "headers") == c(b, "headers"), 1.0).otherwise(0.0)
    gap = c(b, "page") - c(a, "page")
    near = F.when(gap == 1, 1.0).when(gap == 2, 0.5).otherwise(0.0)
    section = F.when(c(a, "section") == c(b, "section"), 1.0).otherwise(0.0)
    parts = ((0.20, caption), (0.35, header), (0.10, align), (0.10, repeat), (0.10, near), (0.15, section))
    total = reduce(lambda x, y: x + y, [w * s for w, s in parts])
    return F.when(c(a, "n_cols") != c(b, "n_cols"), 0.0).otherwise(total)


def iou(a: Column, b: Column) -> Column:
    """Of boxes struct(x0, y0, x1, y1)."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))
