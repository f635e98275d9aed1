"""Queries of table cells and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import semantics as S
from clauseforge.operators import metrics, tables
from clauseforge.plans import fixtures as X
from clauseforge.plans.catalog import query

T1, T2 = X.plain(X.CELLS_V1), X.plain(X.CELLS_V2)


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return X.sql(spark, sf_dir, X.CELLS_V1), X.sql(spark, sf_dir, X.CELLS_V2)


def _rows(source: str) -> str:
    return f"SELECT table_uid, row, list(text ORDER BY col) AS texts FROM ({source}) GROUP BY table_uid, row"


@query("table_rows_fingerprints", f"SELECT table_uid, row, lower(texts[1] || ' | ' || texts[2]) AS row_key, sha256(lower(array_to_string(texts, ' | '))) AS fingerprint FROM ({_rows(T1)})")
def table_rows_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.rows(cells(spark, sf_dir)[0])
    return r.select("table_uid", "row", tables.row_key(F.col("texts")).alias("row_key"), tables.fingerprint(F.col("texts")).alias("fingerprint"))


@query(
    "table_projection",
    "SELECT table_uid, 'columns: " + ", ".join(X.HEADERS) + "' || chr(10) || string_agg(line, chr(10) ORDER BY row) AS projection FROM (SELECT table_uid, row, "
    + " || ' ; ' || ".join(f"'{h}: ' || texts[{i + 1}]" for i, h in enumerate(X.HEADERS))
    + f" AS line, row_number() OVER (PARTITION BY table_uid ORDER BY row) AS n FROM ({_rows(T1)})) WHERE n <= 50 GROUP BY table_uid",
)
def table_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.projection(cells(spark, sf_dir)[0], list(X.HEADERS))


@query("table_markdown", f"SELECT table_uid, row, '| ' || array_to_string(texts, ' | ') || ' |' AS line FROM ({_rows(T1)})")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.markdown_rows(cells(spark, sf_dir)[0])


def _keyed(source: str) -> str:
    return f"SELECT table_uid, texts[1] AS key, array_to_string(texts, ' ') AS all_text FROM ({_rows(source)})"


@query("row_keys", f"SELECT table_uid, key FROM ({_keyed(T1)})")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keyed(cells(spark, sf_dir)[0]).select("table_uid", "key")


@query(
    "row_changes",
    f"SELECT table_uid, key, change FROM (SELECT coalesce(a.table_uid, b.table_uid) AS table_uid, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN lower(a.all_text) <> lower(b.all_text) THEN 'modified' END AS change FROM ({_keyed(T1)}) a FULL JOIN ({_keyed(T2)}) b ON a.table_uid = b.table_uid AND a.key = b.key) WHERE change IS NOT NULL",
)
def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_changes(*cells(spark, sf_dir))


def _addressed(source: str, name: str) -> str:
    return f"SELECT table_uid, max(CASE WHEN col = 0 THEN text END) OVER (PARTITION BY table_uid, row) AS key, col, text AS {name} FROM ({source})"


_CELL_DIFFS = (
    "SELECT * FROM (SELECT coalesce(a.table_uid, b.table_uid) AS table_uid, coalesce(a.key, b.key) AS key, coalesce(a.col, b.col) AS col, old, new, "
    "CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN lower(old) <> lower(new) THEN 'modified' END AS change "
    f"FROM ({_addressed(T1, 'old')}) a FULL JOIN ({_addressed(T2, 'new')}) b ON a.table_uid = b.table_uid AND a.key = b.key AND a.col = b.col) WHERE change IS NOT NULL"
)


@query("cell_diffs", _CELL_DIFFS)
def cell_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_diffs(*cells(spark, sf_dir))


@query(
    "table_diff_summary",
    f"WITH d AS (SELECT table_uid, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'removed') AS n_removed, count(*) FILTER (WHERE change = 'modified') AS n_modified FROM ({_CELL_DIFFS}) GROUP BY table_uid), "
    f"n AS (SELECT table_uid, sum(l) AS ln, sum(r) AS rn FROM (SELECT table_uid, 1 AS l, 0 AS r FROM ({T1}) UNION ALL SELECT table_uid, 0, 1 FROM ({T2})) GROUP BY table_uid), "
    "m AS (SELECT table_uid, ln, rn, coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, coalesce(n_modified, 0) AS n_modified FROM n LEFT JOIN d USING (table_uid)), "
    "s AS (SELECT *, round(2.0 * (ln - n_removed - n_modified) / (ln + rn), 6) AS similarity FROM m) "
    "SELECT table_uid, n_added, n_removed, n_modified, similarity, CASE WHEN similarity > 0.99 THEN 'identical' WHEN n_added + n_removed > 0 THEN 'row_changed' ELSE 'cell_changed' END AS diff_type, "
    "CASE WHEN n_modified > 0 THEN 'high' WHEN n_added + n_removed > 0 THEN 'medium' ELSE 'low' END AS impact FROM s",
)
def table_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_diffs(*cells(spark, sf_dir))


@query(
    "table_bag_jaccard",
    f"WITH a AS (SELECT table_uid, list(DISTINCT lower(text)) AS x FROM ({T1}) GROUP BY table_uid), b AS (SELECT table_uid, list(DISTINCT lower(text)) AS y FROM ({T2}) GROUP BY table_uid), "
    "j AS (SELECT table_uid, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a JOIN b USING (table_uid)) SELECT *, CASE WHEN jaccard >= 0.90 THEN 'unchanged' ELSE 'modified' END AS meaning FROM j",
)
def table_bag_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bag_jaccard(*cells(spark, sf_dir))


@query(
    "bare_facts",
    f"SELECT table_uid, row, col, CAST(regexp_extract(text, '^(\\d+) (V/m|MHz)$', 1) AS DOUBLE) * CASE WHEN text LIKE '% MHz' THEN 1000000.0 ELSE 1.0 END AS value, CASE WHEN text LIKE '% MHz' THEN 'Hz' ELSE 'V/m' END AS unit FROM ({T1}) WHERE col >= 2",
)
def bare_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of cells that are a number and a unit, frequencies in hertz."""
    c = cells(spark, sf_dir)[0].withColumn("n", F.regexp_extract("text", r"^(\d+(?:[.,]\d+)?)\s*(?i:v/m|[kmg]?hz)$", 1)).where("n <> ''")
    unit = F.regexp_extract("text", r"((?i)v/m|[kmg]?hz)$", 1)
    frequency = F.lower(unit).endswith("hz")
    value = F.when(frequency, S.hertz(F.col("n"), unit)).otherwise(F.col("n").cast("double"))
    return c.select("table_uid", "row", "col", value.alias("value"), F.when(frequency, "Hz").otherwise("V/m").alias("unit"))


@query("test_types", "SELECT p_partkey AS k, CASE WHEN contains(lower(p_type), 'esd') THEN 'esd' WHEN contains(lower(p_type), 'ri') OR contains(lower(p_type), 'rs') THEN 'radiated_immunity' WHEN contains(lower(p_type), 'ce') THEN 'conducted_emissions' ELSE 'unknown' END AS test_type FROM part")
def test_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), S.test_type(F.col("p_type")).alias("test_type"))


@query(
    "extraction_metrics",
    f"SELECT table_uid, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols, count(*) AS n_cells, round(100.0 * count(*) FILTER (WHERE trim(text) <> '') / count(*), 4) AS filled, round(100.0 * count(*) FILTER (WHERE regexp_matches(text, '^\\d')) / count(*), 4) AS fact_coverage FROM ({T1}) GROUP BY table_uid",
)
def extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)[0].groupBy("table_uid").agg(
        F.countDistinct("row").alias("n_rows"), F.countDistinct("col").alias("n_cols"), F.count("*").alias("n_cells"),
        metrics.percent(F.count_if(F.trim("text") != ""), F.count("*")).alias("filled"),
        metrics.percent(F.count_if(F.col("text").rlike(r"^\d")), F.count("*")).alias("fact_coverage"),
    )


_PARTS = "SELECT s_nationkey AS doc, s_suppkey AS table_uid, s_suppkey % 40 + s_suppkey % 3 AS page_from, s_suppkey % 40 + s_suppkey % 3 AS page_to, 'caption' AS caption, s_suppkey % 2 + 3 AS n_cols FROM {supplier}"


@query(
    "page_split_merge",
    f"WITH t AS ({X.plain(_PARTS)}), g AS (SELECT *, CASE WHEN page_from = lag(page_to) OVER w + 1 AND n_cols = lag(n_cols) OVER w THEN 0 ELSE 1 END AS b FROM t WINDOW w AS (PARTITION BY doc ORDER BY page_from, table_uid)) "
    "SELECT doc, table_uid, page_from, page_to, caption, n_cols, sum(b) OVER (PARTITION BY doc ORDER BY page_from, table_uid) AS island FROM g",
)
def page_split_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_split_islands(X.sql(spark, sf_dir, _PARTS))


@query(
    "continuation_score",
    "WITH c AS (SELECT p_partkey AS id, p_partkey // 50 AS doc, p_brand AS section, p_partkey % 7 AS page, p_size % 3 AS n_cols, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'T' || CAST(p_partkey % 2 AS STRING) END AS caption, CAST(p_size AS DOUBLE) AS x0, p_partkey % 2 AS h FROM part) "
    "SELECT a.id AS l, b.id AS r, round(CASE WHEN a.n_cols <> b.n_cols THEN 0.0 ELSE 0.20 * CASE WHEN a.caption <> '' AND a.caption = b.caption THEN 1.0 ELSE 0.0 END + 0.35 * CASE WHEN a.h = b.h THEN 1.0 ELSE 1.0 / 3 END + 0.10 * greatest(0.0, 1.0 - abs(a.x0 - b.x0) / 100.0) "
    "+ 0.10 * CASE WHEN a.h = b.h THEN 1.0 ELSE 0.0 END + 0.10 * CASE b.page - a.page WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END + 0.15 END, 6) AS score FROM c a JOIN c b ON a.section = b.section AND b.page - a.page BETWEEN 1 AND 2 AND a.doc = b.doc",
)
def continuation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of candidate tables on the pages that follow, in one section of a document."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    headers = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("limit"), F.lit("unit"))).otherwise(F.array(F.lit("limit"), F.lit("level")))
    caption = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("p_partkey") % 2).cast("string")))
    c = p.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 50).alias("doc"), F.col("p_brand").alias("section"), (F.col("p_partkey") % 7).alias("page"), (F.col("p_size") % 3).alias("n_cols"), caption.alias("caption"), F.col("p_size").cast("double").alias("x0"), headers.alias("headers"))
    gap = F.col("b.page") - F.col("a.page")
    near = c.alias("a").join(c.alias("b"), (F.col("a.section") == F.col("b.section")) & gap.between(1, 2) & (F.col("a.doc") == F.col("b.doc")))
    return near.select(F.col("a.id").alias("l"), F.col("b.id").alias("r"), F.round(tables.continuation_score(), 6).alias("score"))


@query("type_propagation", "SELECT l_orderkey AS doc, l_linenumber AS seq, last_value(t IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS kind, l_partkey AS part, l_extendedprice AS price FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS t FROM lineitem)")
def type_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continued table takes the last known type before it."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.last(known, True).over(w).alias("kind"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price")
    )
