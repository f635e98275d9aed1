"""Differences of two versions of a table by row keys, of tables as JSON, and of
texts line by line."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from clauseforge.functions import text as T

CHANGES = ArrayType(StructType().add("type", StringType()).add("text", StringType()).add("old", StringType()).add("new", StringType()))


def same_cell(a: Column, b: Column) -> Column:
    """Equal but for case and white space."""
    return T.normalize(a) == T.normalize(b)


def _numbered(rows: DataFrame, side: str) -> DataFrame:
    """With the table's number of rows."""
    n = F.count("*").over(W.partitionBy("table_uid"))
    return rows.select("table_uid", F.col("row").alias(f"{side}_row"), T.blank(F.col("key")).alias(f"{side}_key"), F.col("texts").alias(f"{side}_texts"), n.alias(f"{side}_n"))


def row_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``(table_uid, row, key, texts)``, numbered from 0, of tables on both sides:
    ``(table_uid, new_row, new_key, new_texts, old_row, old_texts)``.

    A new row meets the old one that its key names, else the one in its place.  A key
    names a place among the old rows that have keys (of equal keys the last), which is
    the row's own where all have one."""
    a, b = _numbered(old, "old"), _numbered(new, "new")
    place = F.row_number().over(W.partitionBy("table_uid").orderBy("old_row")) - 1
    keyed = a.where("old_key <> ''").withColumn("place", place).groupBy("table_uid", F.col("old_key").alias("k")).agg(F.max("place").alias("place"))
    sizes = a.groupBy("table_uid").agg(F.count("*").alias("n"))
    keyed = keyed.withColumnRenamed("table_uid", "k_uid")
    b = b.join(sizes, "table_uid").join(keyed, (F.col("table_uid") == F.col("k_uid")) & (F.col("new_key") == F.col("k")), "left")
    at = F.coalesce("place", F.when(F.col("new_row") < F.col("n"), F.col("new_row")))
    b = b.withColumn("at", at.cast("long"))
    held = a.select(F.col("table_uid").alias("o_uid"), "old_row", "old_texts")
    return b.join(held, (F.col("table_uid") == F.col("o_uid")) & (F.col("at") == F.col("old_row")), "left").select("table_uid", "new_row", "new_key", "new_texts", "old_row", "old_texts")


def row_diffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(table_uid, row, key, change, n_cells)``: rows that were added, removed or
    modified in ``n_cells`` cells.  An old row that no new one met is removed if it has
    a key or lies beyond the new table's end."""
    pairs = row_pairs(old, new)
    cells = F.arrays_zip(F.col("old_texts").alias("o"), F.col("new_texts").alias("n"))
    changed = F.size(F.filter(cells, lambda x: ~same_cell(x["o"], x["n"])))
    kind = F.when(F.col("old_row").isNull(), "added").when(F.col("n_cells") > 0, "modified")
    here = pairs.withColumn("n_cells", F.when(F.col("old_row").isNotNull(), changed)).withColumn("change", kind).where("change is not null")
    here = here.select("table_uid", F.col("new_row").alias("row"), F.col("new_key").alias("key"), "change", F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))
    met = pairs.where("old_row is not null").select(F.col("table_uid").alias("m_uid"), F.col("old_row").alias("m_row")).distinct()
    sizes = new.groupBy(F.col("table_uid").alias("s_uid")).agg(F.count("*").alias("s_n"))
    a = _numbered(old, "old")
    gone = a.join(sizes, F.col("table_uid") == F.col("s_uid")).join(met, (F.col("table_uid") == F.col("m_uid")) & (F.col("old_row") == F.col("m_row")), "left_anti")
    gone = gone.where("old_key <> '' or old_row >= s_n").select("table_uid", F.col("old_row").alias("row"), F.col("old_key").alias("key"), F.lit("removed").alias("change"), F.lit(0).cast("long").alias("n_cells"))
    return here.unionByName(gone)


def _dice(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.arrays_zip(a.alias("o"), b.alias("n")), lambda x: F.lower(F.trim(x["o"])) == F.lower(F.trim(x["n"]))))
    return F.coalesce(F.try_divide(2.0 * same, F.size(a) + F.size(b)), F.lit(1.0))


def similarity(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(table_uid, similarity)`` of tables on both sides.  Where at least half of both
    tables' rows have keys: 0.7 of the keys' Jaccard similarity and 0.3 of the mean Dice
    similarity of rows that share one (of rows of one key the last); else the Dice
    similarity of rows in the same places.  A difference of columns lessens either."""

    def told(d: DataFrame, side: str) -> DataFrame:
        keys = F.collect_set(F.when(T.blank(F.col("key")) != "", F.col("key")))
        return d.groupBy("table_uid").agg(
            F.count("*").alias(f"{side}_n"), F.count_if(T.blank(F.col("key")) != "").alias(f"{side}_keyed"), keys.alias(f"{side}_keys"),
            F.max(F.size("texts")).alias(f"{side}_cols"), F.sum(F.size("texts")).alias(f"{side}_cells"),
        )

    def last(d: DataFrame, side: str) -> DataFrame:
        return d.where(T.blank(F.col("key")) != "").groupBy("table_uid", "key").agg(F.max_by("texts", "row").alias(f"{side}_texts"))

    by_key = last(old, "o").join(last(new, "n"), ["table_uid", "key"]).groupBy("table_uid").agg(F.avg(_dice(F.col("o_texts"), F.col("n_texts"))).alias("rows_alike"))
    placed = old.select("table_uid", "row", F.col("texts").alias("o_texts")).join(new.select("table_uid", "row", F.col("texts").alias("n_texts")), ["table_uid", "row"])
    same = F.size(F.filter(F.arrays_zip(F.col("o_texts").alias("o"), F.col("n_texts").alias("n")), lambda x: F.lower(F.trim(x["o"])) == F.lower(F.trim(x["n"]))))
    by_place = placed.groupBy("table_uid").agg(F.sum(same).alias("same"))
    both = told(old, "o").join(told(new, "n"), "table_uid").join(by_key, "table_uid", "left").join(by_place, "table_uid", "left")
    penalty = F.abs(F.col("o_cols") - F.col("n_cols")) / F.greatest("o_cols", "n_cols", F.lit(1))
    keyed = (2 * F.col("o_keyed") >= F.col("o_n")) & (2 * F.col("n_keyed") >= F.col("n_n"))
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("o_keys", "n_keys")).cast("double"), F.size(F.array_union("o_keys", "n_keys"))), F.lit(1.0))
    by_keys = (0.70 * jaccard + 0.30 * F.coalesce("rows_alike", F.lit(0.0))) * (1 - F.least(penalty, F.lit(0.40)) * 0.5)
    by_places = F.coalesce(F.try_divide(2.0 * F.coalesce("same", F.lit(0)), F.col("o_cells") + F.col("n_cells")), F.lit(0.0)) * (1 - penalty * 0.5)
    return both.select("table_uid", F.round(F.when(keyed, by_keys).otherwise(by_places), 6).alias("similarity"))


_TABLE = "struct<table_uid:string,section_path:array<string>,caption_normalized:string,dimensions:struct<num_cols:int>,split_info:struct<is_split:boolean>,rows:array<struct<cells:array<string>>>>"


def json_diff(old: Column, new: Column) -> Column:
    """struct(similarity, structural, rows_added, rows_removed, rows_modified,
    cells_modified, kind, impact) of two tables as JSON.  Rows and cells meet in their
    places, similarity is the share of characters that are equal in theirs."""
    from clauseforge.operators.shapes import diff_type

    def compared(s: Column) -> Column:
        a, b = s["a"], s["b"]
        rows = lambda t: F.coalesce(t["rows"], F.array().cast("array<struct<cells:array<string>>>"))
        n_old, n_new = F.size(rows(a)), F.size(rows(b))
        met = F.slice(F.arrays_zip(rows(a).alias("o"), rows(b).alias("n")), 1, F.greatest(F.least(n_old, n_new), F.lit(0)))
        cells = lambda x: F.slice(F.arrays_zip(x["o"]["cells"].alias("o"), x["n"]["cells"].alias("n")), 1, F.least(F.size(x["o"]["cells"]), F.size(x["n"]["cells"])))
        n_rows = F.size(F.filter(met, lambda x: ~x["o"]["cells"].eqNullSafe(x["n"]["cells"])))
        n_cells = F.aggregate(met, F.lit(0), lambda n, x: n + F.size(F.filter(cells(x), lambda y: ~y["o"].eqNullSafe(y["n"]))))
        structural = F.array_compact(
            F.array(
                F.when(~a["section_path"].eqNullSafe(b["section_path"]), "moved_section"),
                F.when(~a["caption_normalized"].eqNullSafe(b["caption_normalized"]), "caption_changed"),
                F.when(~a["dimensions"]["num_cols"].eqNullSafe(b["dimensions"]["num_cols"]), "columns_changed"),
                F.when(~a["split_info"]["is_split"].eqNullSafe(b["split_info"]["is_split"]), "split_status_changed"),
            )
        )
        letters = F.arrays_zip(F.split(s["old"], "").alias("o"), F.split(s["new"], "").alias("n"))
        alike = F.coalesce(F.try_divide(F.size(F.filter(letters, lambda x: x["o"] == x["n"])).cast("double"), F.greatest(F.length(s["old"]), F.length(s["new"]))), F.lit(0.0))
        return F.struct(
            F.round(F.when((s["old"] == "") | (s["new"] == ""), 0.0).otherwise(alike), 6).alias("similarity"), structural.alias("structural"), F.greatest(n_new - n_old, F.lit(0)).alias("rows_added"),
            F.greatest(n_old - n_new, F.lit(0)).alias("rows_removed"), n_rows.alias("rows_modified"), n_cells.alias("cells_modified"),
        )

    def judged(d: Column) -> Column:
        kind = diff_type(d["similarity"], d["structural"], F.lit(0), d["rows_added"] + d["rows_removed"], d["rows_modified"])
        labels_only = F.size(F.array_except(d["structural"], F.array(F.lit("caption_changed"), F.lit("moved_section")))) == 0
        still = (d["cells_modified"] == 0) & (d["rows_modified"] == 0) & (d["rows_added"] == 0) & (d["rows_removed"] == 0)
        impact = F.when(kind == "identical", "identical").when(still & labels_only, "low").when(d["cells_modified"] < 5, "medium").otherwise("high")
        return F.struct(*[d[c].alias(c) for c in ("similarity", "structural", "rows_added", "rows_removed", "rows_modified", "cells_modified")], kind.alias("kind"), impact.alias("impact"))

    pair = F.struct(T.blank(old).alias("old"), T.blank(new).alias("new"), F.from_json(old, _TABLE).alias("a"), F.from_json(new, _TABLE).alias("b"))
    return T.let(T.let(pair, compared), judged)


def changed_lines(left: str | None, right: str | None, alike: float = 0.6) -> list[dict]:
    """The lines and dashed items that differ: of the old lines that are gone those with
    a similar new one are modified, others removed; new lines besides are added."""
    old, new = ([x for y in (t or "").replace(" - ", "\n- ").split("\n") if (x := y.strip())] for t in (left, right))
    out, known = [], set(new)
    for line in old:
        if line in known:
            continue
        like = next((x for x in new if SequenceMatcher(None, line.lower(), x.lower()).ratio() > alike), None)
        out.append({"type": "removed" if like is None else "modified", "text": line, "old": like and line, "new": like})
    reused, had = {c["new"] for c in out}, set(old)
    return out + [{"type": "added", "text": x, "old": None, "new": None} for x in new if x not in had and x not in reused]


@F.arrow_udf(CHANGES)
def _line_changes(a: pa.Array, b: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("type", "text", "old", "new")]))
    return pa.array([changed_lines(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], kind)


def line_changes(left: Column, right: Column) -> Column:
    """``changed_lines`` as a Column; equal texts reach Python as nulls."""
    apart = ~left.eqNullSafe(right)
    return _line_changes(F.when(apart, left), F.when(apart, right))
