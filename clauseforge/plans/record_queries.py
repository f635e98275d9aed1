"""Queries of nodes before and of change records after a comparison, and of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.operators import changes, nodes, records
from clauseforge.plans import fixtures as X
from clauseforge.plans.catalog import query
from clauseforge.plans.text_queries import C1, C2
from clauseforge.sources import stores


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return X.sql(spark, sf_dir, X.CLAUSES_V1), X.sql(spark, sf_dir, X.CLAUSES_V2)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, removed and added clauses with a severity by their kind alone."""
    a = changes.align(*versions(spark, sf_dir)).where("not (l_text <=> r_text and l_section <=> r_section)")
    severity = F.when(F.col("change_type") != "MODIFIED", "high").when(F.col("l_section") != F.col("r_section"), "medium").otherwise("low")
    where = F.coalesce("l_section", "r_section")
    return a.select(
        F.split(where, " / ")[0].alias("pair"), "node", "change_type", where.alias("section"), "l_section", "r_section", "l_text", "r_text", severity.alias("severity"),
        F.coalesce("l_page", "r_page").alias("page"), F.when(F.col("change_type") == "MODIFIED", 0.4).otherwise(1.0).alias("confidence"), F.col("node").cast("string").alias("change_id"),
    )


_ALIGNED = (
    f"(WITH a AS ({C1}), b AS ({C2}) SELECT split_part(coalesce(a.section, b.section), ' / ', 1) AS pair, coalesce(a.node, b.node) AS node, "
    "CASE WHEN a.node IS NULL THEN 'ADDED' WHEN b.node IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, coalesce(a.section, b.section) AS section, a.section AS l_section, b.section AS r_section, "
    "a.text AS l_text, b.text AS r_text, CASE WHEN a.node IS NULL OR b.node IS NULL THEN 'high' WHEN a.section <> b.section THEN 'medium' ELSE 'low' END AS severity, coalesce(a.page, b.page) AS page "
    "FROM a FULL JOIN b ON a.node = b.node WHERE a.text IS DISTINCT FROM b.text OR a.section IS DISTINCT FROM b.section)"
)
_ORDER = "CASE severity WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, node"


@query(
    "change_details",
    "SELECT node, CASE WHEN change_type <> 'MODIFIED' THEN 1 ELSE CAST(l_section <> r_section AS INT) + CAST(l_text <> r_text AS INT) END AS n, "
    "CASE WHEN change_type = 'ADDED' THEN 'added' WHEN change_type = 'REMOVED' THEN 'removed' ELSE 'modified' END AS first_type, CASE WHEN l_section <> r_section THEN 'section' END AS location, "
    f"CASE WHEN change_type = 'ADDED' THEN r_text WHEN change_type = 'REMOVED' THEN l_text WHEN l_section <> r_section THEN 'Node moved between sections' ELSE 'Text changed' END AS said FROM {_ALIGNED}",
)
def change_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = aligned(spark, sf_dir)
    moved = F.when(F.col("l_section") != F.col("r_section"), "moved").otherwise("same")
    d = records.details(F.col("change_type"), moved, F.col("l_text"), F.col("r_text"), F.col("l_section"), F.col("r_section"))
    d = a.select("node", d.alias("d"))
    return d.select("node", F.size("d").alias("n"), F.col("d")[0]["type"].alias("first_type"), F.col("d")[0]["location"].alias("location"), F.col("d")[0]["text"].alias("said"))


@query("chapters", f"SELECT pair, pair AS chapter, count(*) AS n, count(*) FILTER (WHERE change_type = 'MODIFIED') AS unresolved, greatest(1, CAST(floor(sum(len(coalesce(l_text, '')) + len(coalesce(r_text, ''))) / 4) AS BIGINT)) AS tokens, string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) AS change_ids FROM {_ALIGNED} GROUP BY pair")
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chapters(aligned(spark, sf_dir))


@query(
    "action_plan",
    f"SELECT pair, place, 'High' AS priority, 'Assess compliance impact of ' || lower(change_type) || ' items in ' || section AS action, '60 days' AS timeline, 'Compliance Team' AS owner FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY {_ORDER}) AS place FROM {_ALIGNED} WHERE severity = 'high') WHERE place <= 5",
)
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.action_plan(aligned(spark, sf_dir))


@query("diff_sample", f"SELECT pair, node, change_type FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY sha256('42:' || CAST(node AS VARCHAR)), CAST(node AS VARCHAR)) AS place FROM {_ALIGNED}) WHERE place <= 10")
def diff_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.sample(aligned(spark, sf_dir)).select("pair", "node", "change_type")


_CITED = f"(SELECT * REPLACE (CASE WHEN node % 3 > 0 THEN l_text END AS l_text, CASE WHEN node % 4 > 0 THEN r_text END AS r_text) FROM {_ALIGNED})"
_ANY, _BOTH = "count(*) FILTER (WHERE l_text IS NOT NULL OR r_text IS NOT NULL)", "count(*) FILTER (WHERE l_text IS NOT NULL AND r_text IS NOT NULL)"


@query("citation_coverage", f"SELECT pair, count(*) AS total, {_ANY} AS any_citation, {_BOTH} AS both_citations, round({_ANY}::DOUBLE / count(*), 4) AS coverage FROM {_CITED} GROUP BY pair")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose sides are not all found again."""
    a = aligned(spark, sf_dir)
    return records.citation_coverage(a.withColumns({"l_text": F.when(F.col("node") % 3 > 0, F.col("l_text")), "r_text": F.when(F.col("node") % 4 > 0, F.col("r_text"))}), "pair")


_SAID = "CASE node % 4 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'HUMAN_REVIEW: check ' || CAST(node AS STRING) ELSE 'changed ' || CAST(node AS STRING) END"


@query(
    "report_events",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY {_ORDER}) AS place FROM {_ALIGNED}) "
    "SELECT pair, 2 * place - 1 AS seq, 'diff_start' AS type, CAST(node AS VARCHAR) AS change_id, NULL AS row_markdown, CAST(NULL AS BOOLEAN) AS skipped, CAST(NULL AS BOOLEAN) AS requires_review FROM r "
    "UNION ALL SELECT pair, 2 * place, 'diff_complete', CAST(node AS VARCHAR), CASE WHEN node % 4 <> 0 THEN '| ' || section || ' | p.' || CAST(page AS VARCHAR) || ' | ' || upper(change_type[1]) || lower(change_type[2:]) || ' | ' || CASE WHEN node % 4 = 1 THEN '⚠ check ' ELSE 'changed ' END || CAST(node AS VARCHAR) || ' |' END, node % 4 = 0, node % 4 = 1 FROM r "
    "UNION ALL SELECT pair, 2 * max(place) + 1, 'done', NULL, NULL, NULL, NULL FROM r GROUP BY pair",
)
def report_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.events(aligned(spark, sf_dir).withColumn("said", F.expr(_SAID)))


@query(
    "unchanged_sections",
    f"WITH a AS (SELECT CAST(node // 4 AS VARCHAR) AS section, text, count(*) AS n FROM ({C1}) GROUP BY ALL), b AS (SELECT CAST(node // 4 AS VARCHAR) AS section, text, count(*) AS n FROM ({C2}) GROUP BY ALL), s AS (SELECT DISTINCT section FROM a), "
    "d AS (SELECT coalesce(a.section, b.section) AS section FROM a FULL JOIN b ON a.section = b.section AND a.text = b.text WHERE a.n IS DISTINCT FROM b.n) "
    "SELECT section AS l_section, section AS r_section FROM s WHERE section NOT IN (SELECT section FROM d)",
)
def unchanged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of neighbouring clauses that have the same ones."""
    a, b = (v.withColumn("section", F.floor(F.col("node") / 4).cast("string")) for v in versions(spark, sf_dir))
    pairs = a.select(F.col("section").alias("l_section"), F.col("section").alias("r_section")).distinct()
    return records.unchanged_sections(a, b, pairs)


@query("split_tables")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed and added clauses taken for tables of their sections."""
    a = aligned(spark, sf_dir).where("change_type <> 'MODIFIED'")
    return records.consolidated(a.select("section", "change_type", F.coalesce("l_text", "r_text").alias("text")))


@query(
    "extraction_score",
    f"SELECT section AS doc, count(*) AS total, count(*) FILTER (WHERE node % 5 > 1) AS clauses, count(*) FILTER (WHERE node % 5 = 0) AS tables, count(*) FILTER (WHERE node % 5 = 1) AS headings, 0 AS figures, CAST(floor(avg(len(text))) AS BIGINT) AS avg_length, "
    f"CAST(floor(100 * count(*) FILTER (WHERE node % 5 <> 1) / count(*)) AS BIGINT) AS content_percent, CAST(floor(100 * count(*) FILTER (WHERE node % 3 > 0) / count(*)) AS BIGINT) AS section_percent FROM ({C1}) GROUP BY section",
)
def extraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("node")
    kind = F.when(k % 5 == 0, "table").when(k % 5 == 1, "heading").otherwise("clause")
    return records.extraction_score(versions(spark, sf_dir)[0].select(F.col("section").alias("doc"), kind.alias("kind"), "text", F.when(k % 3 > 0, F.col("section")).alias("section")))


@query(
    "extraction_audit",
    "WITH n AS (SELECT split_part(section, ' / ', 1) AS doc, node % 4 AS k, node % 7 = 0 AS bare, section, page FROM (" + C1 + ")), "
    "m AS (SELECT *, CASE k WHEN 0 THEN 'table' WHEN 1 THEN 'section' ELSE 'paragraph' END AS t, CASE WHEN k <> 1 AND NOT bare THEN 2 END AS depth FROM n) "
    "SELECT doc, count(*) AS nodes, count(*) FILTER (WHERE k <> 1) AS content_nodes, round(100.0 * count(depth) / greatest(count(*) FILTER (WHERE k <> 1), 1), 1) AS section_coverage, round(coalesce(avg(depth), 0), 2) AS avg_depth, coalesce(max(depth), 0) AS max_depth, "
    "count(DISTINCT CASE WHEN depth IS NOT NULL THEN section END) AS sections, count(*) FILTER (WHERE k = 0) AS tables, count(*) FILTER (WHERE k = 0 AND page % 2 = 0) AS placeholder_tables, "
    "round(100.0 * count(*) FILTER (WHERE k = 0 AND page % 2 = 1) / greatest(count(*) FILTER (WHERE k = 0), 1), 4) AS table_quality, count(*) FILTER (WHERE k = 0 AND page % 3 = 0) AS cross_page_tables, 0 AS empty_nodes FROM m GROUP BY doc",
)
def extraction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, page = F.col("node") % 4, F.col("page")
    kind = F.when(k == 0, "table").when(k == 1, "section").otherwise("paragraph")
    path = F.when(F.col("node") % 7 == 0, F.array().cast("array<string>")).otherwise(F.split("section", " / "))
    head = F.when(page % 2 == 0, F.array(F.lit("level"), F.lit("column_2"))).otherwise(F.array(F.lit("level")))
    n = versions(spark, sf_dir)[0].select(F.split("section", " / ")[0].alias("doc"), kind.alias("node_type"), path.alias("path"), "text", head.alias("headers"), page.alias("page_from"), F.when(page % 3 == 0, page + 1).alias("page_to"))
    return records.audit(n)


@query(
    "extraction_delta",
    "WITH a AS (SELECT split_part(section, ' / ', 1) AS doc, node, 0 AS s FROM (" + C1 + ") UNION ALL SELECT split_part(section, ' / ', 1), node, 1 FROM (" + C2 + ")), "
    "c AS (SELECT doc, count(*) FILTER (WHERE s = 0) AS nodes_before, count(*) FILTER (WHERE s = 1) AS nodes_after, count(*) FILTER (WHERE s = 0 AND node % 4 = 0) AS tables_before, count(*) FILTER (WHERE s = 1 AND node % 4 = 0) AS tables_after, "
    "count(*) FILTER (WHERE s = 0 AND node % 8 = 0) AS stitched_before, count(*) FILTER (WHERE s = 1 AND node % 8 = 0) AS stitched_after FROM a GROUP BY doc) SELECT *, tables_after - tables_before AS delta_tables, stitched_after - stitched_before AS delta_stitched FROM c",
)
def extraction_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("node")
    a, b = (v.select(F.split("section", " / ")[0].alias("doc"), F.when(k % 4 == 0, "table").otherwise("clause").alias("node_type"), (k % 8 == 0).alias("stitched")) for v in versions(spark, sf_dir))
    return records.extraction_delta(a, b)


@query("page_stitch")
def page_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, ten a page, as paragraphs that page breaks split."""
    from clauseforge.plans.text_queries import lines

    n = lines(spark, sf_dir).select(
        F.col("doc_id").alias("doc"), F.lit("s").alias("section"), F.floor(F.col("ord") / 10).alias("page"), "ord", F.lit("paragraph").alias("node_type"), F.col("line").alias("text"),
        F.lit(0).alias("n_cols"), F.lit(False).alias("has_header"), F.lit(False).alias("is_list"),
    )
    return nodes.stitched(n)


@query(
    "content_nodes",
    "WITH n AS (SELECT split_part(section, ' / ', 1) AS doc, section, node, CASE WHEN node % 6 = 0 THEN 0 WHEN node % 2 = 0 THEN 1 ELSE 2 END AS r FROM (" + C1 + ")) SELECT section AS doc, node FROM (SELECT *, max(r) OVER (PARTITION BY section) AS best FROM n) WHERE r = best",
)
def content_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("node")
    n = versions(spark, sf_dir)[0].select(F.col("section").alias("doc"), "node", F.when(k % 6 == 0, "figure").otherwise("clause").alias("node_type"), "text", (k % 2 == 0).alias("low_priority"))
    return nodes.content_nodes(n).select("doc", "node")


@query(
    "inherited_exclusions",
    "SELECT split_part(section, ' / ', 1) AS doc, node, CASE WHEN split_part(section, ' / ', 1) = 'BUILDING' THEN 'segment' ELSE 'nation' END AS reason FROM (" + C1 + ") WHERE split_part(section, ' / ', 1) = 'BUILDING' OR section LIKE '%1'",
)
def inherited_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = versions(spark, sf_dir)[0].select(F.split("section", " / ")[0].alias("doc"), "node", F.split("section", " / ").alias("path"))
    whole = c.select("doc", F.slice("path", 1, 1).alias("path")).where("doc = 'BUILDING'").distinct().withColumn("reason", F.lit("segment"))
    part = c.select("doc", "path").where("path[1] like '%1'").distinct().withColumn("reason", F.lit("nation"))
    return nodes.inherited_exclusions(c, whole.unionByName(part))


@query(
    "ocr_page_ranges",
    "WITH r AS (SELECT DISTINCT p_partkey % 20 AS doc, greatest(1, p_partkey % 97 + 1 - 1) AS low, least(97, p_partkey % 97 + 1 + 1) AS high FROM part WHERE p_size / 50.0 < 0.3), "
    "g AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY doc ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS apart FROM r), "
    "i AS (SELECT *, sum(apart) OVER (PARTITION BY doc ORDER BY low, high) AS island FROM g) SELECT doc, min(low) AS first, max(high) AS last FROM i GROUP BY doc, island",
)
def ocr_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return nodes.page_ranges(spark.read.parquet(f"{sf_dir}/part.parquet").select((k % 20).alias("doc"), (k % 97 + 1).alias("page"), (F.col("p_size") / 50.0).alias("density"), F.lit(97).alias("pages")))


@query("text_blocks")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as blocks, as scanned pages are."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(nodes.blocks(F.col("text"))).alias("ord", "block"))


@query(
    "node_upsert",
    f"SELECT node, section, text FROM ({C2}) UNION ALL SELECT node, section, text FROM ({C1}) WHERE node NOT IN (SELECT node FROM ({C2}))",
)
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 with version 2 put over it, of which older rows come in too."""
    a, b = (v.select("node", "section", "text") for v in versions(spark, sf_dir))
    stale = b.withColumns({"text": F.lit("stale"), "at": F.lit(0)})
    return stores.upsert(a.withColumn("at", F.lit(0)), b.withColumn("at", F.lit(1)).unionByName(stale), "node", "at").drop("at")


@query(
    "cached_pairs",
    "SELECT o_orderkey AS k, sha256('v2::' || CAST(o_custkey AS VARCHAR) || '::' || CAST(o_orderkey AS VARCHAR)) AS key, epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) <= 86400 * 365 AS fresh, "
    "CASE o_orderstatus WHEN 'O' THEN 'failed' WHEN 'F' THEN 'failed' ELSE 'failed' END AS state FROM orders",
)
def cached_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = stores.cache_key(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    fresh = stores.is_fresh(F.col("o_orderdate").cast("string"), F.lit("1998-01-01").cast("timestamp"), 86400 * 365)
    return o.select(F.col("o_orderkey").alias("k"), key.alias("key"), fresh.alias("fresh"), stores.job_state(F.col("o_orderstatus")).alias("state"))


@query(
    "folded_reports",
    f"SELECT pair, true AS complete, count(*) AS n_diffs, count(*) FILTER (WHERE node % 4 = 0) AS n_skipped, bool_or(node % 4 = 1) AS requires_review, 2 * count(*) + 1 AS last_seq FROM {_ALIGNED} GROUP BY pair",
)
def folded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.folded(report_events(spark, sf_dir))


@query(
    "key_differences",
    "SELECT coalesce(a.node, b.node) AS node, CASE WHEN b.node IS NULL THEN 'REMOVED' WHEN a.node IS NULL THEN 'ADDED' ELSE 'MODIFIED' END AS change_type "
    f"FROM ({C1}) a FULL JOIN ({C2}) b ON a.node = b.node WHERE a.text IS DISTINCT FROM b.text AND (coalesce(a.node, b.node) % 9 <> 0 OR coalesce(a.node, b.node) % 2 = 0)",
)
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth clause stands in a glossary, every other of these under a numbered table."""
    k = F.col("node")
    glossary = F.when(k % 18 == 0, "Glossary / Tabelle 3").when(k % 9 == 0, "Glossary")
    group = lambda c: F.when(F.col(c).isNotNull(), F.floor(k / 4).cast("string"))
    pairs = changes.align(*versions(spark, sf_dir)).withColumns({"section": F.coalesce(glossary, "l_section", "r_section"), "l_section": group("l_section"), "r_section": group("r_section")})
    return records.key_differences(pairs, unchanged_sections(spark, sf_dir)).select("node", "change_type")
