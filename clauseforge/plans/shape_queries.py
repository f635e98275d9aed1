"""Queries of labels and of the structure of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.functions import labels
from clauseforge.functions import lexicon as L
from clauseforge.operators import shapes
from clauseforge.plans import fixtures as X
from clauseforge.plans.catalog import query
from clauseforge.plans.table_queries import T1, T2, cells
from clauseforge.plans.text_queries import C1, C2, q

H1, H2 = X.plain(X.HEADED_V1), X.plain(X.HEADED_V2)
# Cells of the headed tables without their caption rows.
_BARE = (
    "(SELECT table_uid, row - CASE WHEN moved THEN 1 ELSE 0 END AS row, col, col_span, text FROM (SELECT *, max(caption) OVER (PARTITION BY table_uid) AS moved "
    "FROM (SELECT *, row = 0 AND text LIKE 'Table 7%' AS caption FROM ({source}))) WHERE NOT caption)"
)
B1, B2 = (_BARE.replace("{source}", s) for s in (H1, H2))


def headed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return X.sql(spark, sf_dir, X.HEADED_V1), X.sql(spark, sf_dir, X.HEADED_V2)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed headers of the plain tables."""
    return cells(spark, sf_dir)[0].select("table_uid").distinct().withColumn("headers", F.array(*map(F.lit, X.HEADERS)))


@query(
    "section_labels",
    f"SELECT node, nullif(regexp_extract(section, {q('(?i)' + L.SECTION_LABEL)}, 1), '') AS label, nullif(regexp_extract(head, {q('(?i)' + L.SECTION_LABEL)}, 1), '') AS own FROM (SELECT node, section, 'Section ' || CAST(page AS VARCHAR) || ' of ' || section AS head FROM ({C1}))",
)
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = X.sql(spark, sf_dir, X.CLAUSES_V1), F.lit(None).cast("string")
    head = F.concat_ws("", F.lit("Section "), F.col("page").cast("string"), F.lit(" of "), F.col("section"))
    return c.select("node", labels.section_label(none, F.col("section"), none).alias("label"), labels.section_label(head, F.col("section"), none).alias("own"))


@query(
    "section_titles",
    "SELECT node, lower(section) AS title, CAST(page AS VARCHAR) AS bare, CASE WHEN node % 3 = 0 THEN CAST(page AS VARCHAR) || 'a' END AS number, replace(lower(section), '_', '') AS caption "
    f"FROM ({C1})",
)
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, captions and caption numbers, with numbers put before the section."""
    c = X.sql(spark, sf_dir, X.CLAUSES_V1)
    page = F.col("page").cast("string")
    return c.select(
        "node", F.lower(labels.section_title(F.concat(F.lit("Section "), page, F.lit(".2 - "), F.col("section")))).alias("title"), labels.section_title(page).alias("bare"),
        labels.caption_number(F.array("section", F.concat(F.when(F.col("node") % 3 == 0, "Tabelle ").otherwise("Bild "), page, F.lit("A")))).alias("number"),
        labels.caption(F.concat(F.lit("**Table "), page, F.lit(": "), F.col("section"), F.lit("**"))).alias("caption"),
    )


@query(
    "node_types",
    "SELECT node, CASE node % 5 WHEN 0 THEN 'list_item' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' WHEN 3 THEN 'definition' ELSE 'paragraph' END AS kind, "
    "CASE node % 5 WHEN 0 THEN 'toc' WHEN 1 THEN 'header_footer' WHEN 2 THEN 'boilerplate' END AS suppressed, CASE node % 5 WHEN 3 THEN 'heading' WHEN 4 THEN 'table' END AS mapped "
    f"FROM ({C1})",
)
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node types and suppressions of clauses whose labels follow from their key."""
    c = X.sql(spark, sf_dir, X.CLAUSES_V1)
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("node") % 5 + 1).cast("int"))
    label, title = pick("bullet", "", "", "", ""), pick("", "Caution", "Note 1", "", "")
    kind = labels.node_type(F.lit("clause"), F.array(label), title, pick("", "", "", "Glossary", "Scope"))
    mark = pick("toc", "page_footer", "index", "title", "table")
    return c.select("node", kind.alias("kind"), labels.suppression(mark, F.col("text")).alias("suppressed"), labels.label_type(mark).alias("mapped"))


@query(
    "normative_changes",
    f"WITH v AS (SELECT node, CASE WHEN regexp_matches(text, ' shall ') THEN 5 WHEN regexp_matches(text, ' must ') THEN 4 WHEN regexp_matches(text, ' should ') THEN 1 WHEN regexp_matches(text, ' may ') THEN 0 END AS s FROM ({C1})), "
    f"w AS (SELECT node, CASE WHEN regexp_matches(text, ' shall ') THEN 5 WHEN regexp_matches(text, ' must ') THEN 4 WHEN regexp_matches(text, ' should ') THEN 1 WHEN regexp_matches(text, ' may ') THEN 0 END AS s FROM ({C2})) "
    "SELECT node, CASE WHEN w.s > v.s THEN 'strengthened' ELSE 'weakened' END AS direction FROM v JOIN w USING (node) WHERE w.s <> v.s",
)
def normative_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (X.sql(spark, sf_dir, t).select("node", F.col("text").alias(n)) for t, n in ((X.CLAUSES_V1, "l"), (X.CLAUSES_V2, "r")))
    return a.join(b, "node").select("node", labels.normative_change(F.col("l"), F.col("r")).alias("direction")).where("direction is not null")


@query("table_headers", f"SELECT DISTINCT table_uid, 'phenomenon|frequenzbereich||level min|level max' AS headers, 2 AS depth FROM ({H1})")
def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers over two rows, a word broken over two columns joined."""
    h = shapes.headers(shapes.without_caption_row(headed(spark, sf_dir)[0]))
    return h.select("table_uid", F.array_join("headers", "|").alias("headers"), "depth")


@query("caption_rows", f"SELECT table_uid, row, col, text FROM {B1}")
def caption_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.without_caption_row(headed(spark, sf_dir)[0]).select("table_uid", "row", "col", "text")


_SECTION = "CASE CAST(substr(table_uid, 7) AS BIGINT) % 4 WHEN 0 THEN 'Annex A' WHEN 1 THEN 'Annex A / Tabelle 3' ELSE 'Limits' END"


@query(
    "table_verdicts",
    f"SELECT table_uid, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, CAST(1.0 AS DOUBLE) AS density, CASE WHEN {_SECTION} LIKE '%Tabelle%' THEN NULL WHEN {_SECTION} LIKE 'Annex%' THEN 'reference_section' "
    f"WHEN max(row) < 1 THEN 'too_small' WHEN count(*) < 0.4 * (max(row) + 1) * 4 THEN 'sparse' END AS reason FROM ({T1}) GROUP BY table_uid",
)
def table_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.verdicts(cells(spark, sf_dir)[0].withColumn("section", F.expr(_SECTION)))


@query(
    "header_repeats",
    "WITH t AS (SELECT p_partkey % 10 AS doc, p_partkey AS table_uid, p_partkey // 10 + p_size % 2 AS page, p_size % 3 AS k FROM part), "
    "n AS (SELECT *, lead(table_uid) OVER w AS next_uid, lead(page) OVER w AS np, lead(k) OVER w AS nk FROM t WINDOW w AS (PARTITION BY doc ORDER BY table_uid)) "
    "SELECT doc, table_uid, next_uid FROM n WHERE np = page + 1 AND (k = nk OR (k < 2 AND nk < 2))",
)
def header_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of three kinds, of which two share two of three."""
    k = F.col("p_size") % 3
    words = F.when(k == 0, F.array(*map(F.lit, ("Limit", "unit", "port")))).when(k == 1, F.array(*map(F.lit, ("limit", "Unit ", "band")))).otherwise(F.array(F.lit("level")))
    uid, page = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10) + F.col("p_size") % 2
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select((uid % 10).alias("doc"), uid.alias("ord"), uid.alias("table_uid"), page.alias("page"), words.alias("headers"))
    return shapes.header_repeats(t)


@query("generic_row_keys", f"SELECT table_uid, row, max(CASE WHEN col = 0 THEN text END) AS requirement_id, CAST('' AS VARCHAR) AS condition FROM ({T1}) GROUP BY table_uid, row")
def generic_row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauseforge.operators import tables

    key = shapes.generic_key(F.array_join("texts", " "))
    return tables.rows(cells(spark, sf_dir)[0]).select("table_uid", "row", key["requirement_id"].alias("requirement_id"), key["condition"].alias("condition"))


@query(
    "domain_row_keys",
    f"SELECT table_uid, row, replace(lower(max(CASE WHEN col = 3 THEN text END)), ' ', '_') || ':' || replace(lower(max(CASE WHEN col = 0 THEN text END)), ' ', '_') AS key FROM ({T1}) GROUP BY table_uid, row",
)
def domain_row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row keys of conducted emissions: the frequency range, then the limit class,
    here in the column of requirements."""
    head = F.array(F.lit("Grenzwert"), F.lit("Brand"), F.lit("Field strength"), F.lit("Frequency range"))
    n = named(spark, sf_dir).select("table_uid", head.alias("headers"), F.lit("conducted_emissions").alias("test_type"))
    return shapes.domain_keys(cells(spark, sf_dir)[0], n)


@query(
    "table_best_match",
    f"WITH l AS (SELECT 'x ' || table_uid AS l_uid, row, col, lower(text) AS said FROM ({T1})), r AS (SELECT table_uid AS r_uid, row, col, lower(text) AS said FROM ({T2})), "
    "ln AS (SELECT l_uid, count(*) AS ln FROM l GROUP BY l_uid), rn AS (SELECT r_uid, count(*) AS rn FROM r GROUP BY r_uid), "
    "m AS (SELECT l_uid, r_uid, count(*) AS n FROM l JOIN r USING (row, col, said) GROUP BY l_uid, r_uid), "
    "s AS (SELECT l_uid, r_uid, round(2.0 * n / (ln + rn), 6) AS similarity FROM m JOIN ln USING (l_uid) JOIN rn USING (r_uid)), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY l_uid ORDER BY similarity DESC, r_uid) AS k FROM s WHERE similarity > 0.65) "
    "SELECT 'policy' AS doc, l_uid, r_uid, similarity FROM ln LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (l_uid)",
)
def table_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of both versions matched by their cells alone."""
    a, b = (c.withColumn("doc", F.lit("policy")) for c in cells(spark, sf_dir))
    return shapes.match_tables(a.withColumn("table_uid", F.concat(F.lit("x "), "table_uid")), b, "doc")


@query(
    "positional_changes",
    f"WITH a AS (SELECT table_uid, row, col, text AS old FROM {B1}), b AS (SELECT table_uid, row, col, text AS new FROM {B2}), h AS (SELECT table_uid, max(row) + 1 AS height FROM a GROUP BY table_uid) "
    "SELECT table_uid, row, col, CASE WHEN old IS NULL THEN 'added' ELSE 'modified' END AS change, old, new FROM b LEFT JOIN a USING (table_uid, row, col) JOIN h USING (table_uid) WHERE old <> new OR (old IS NULL AND row >= height)",
)
def positional_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.positional_changes(*headed(spark, sf_dir))


@query(
    "grid_similarity",
    f"WITH a AS (SELECT table_uid, row, col, lower(text) AS x FROM ({T1})), b AS (SELECT table_uid, row, col, lower(text) AS y FROM ({T2})), "
    "m AS (SELECT table_uid, count(*) FILTER (WHERE x = y) AS n FROM a JOIN b USING (table_uid, row, col) GROUP BY table_uid), "
    "s AS (SELECT table_uid, count(*) AS ln FROM a GROUP BY table_uid), t AS (SELECT table_uid, count(*) AS rn FROM b GROUP BY table_uid) "
    "SELECT table_uid, round(2.0 * coalesce(n, 0) / (ln + rn), 6) AS similarity FROM s JOIN t USING (table_uid) LEFT JOIN m USING (table_uid)",
)
def grid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.grid_similarity(*cells(spark, sf_dir))


@query("table_severity")
def table_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.severity(*headed(spark, sf_dir))


@query("entity_profiles")
def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.entity_profiles(cells(spark, sf_dir)[0], named(spark, sf_dir))


@query("entity_changes")
def entity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = named(spark, sf_dir)
    old, new = (shapes.entity_profiles(c, n) for c in cells(spark, sf_dir))
    return shapes.entity_changes(old, new, "frequency")


@query(
    "table_html",
    "SELECT table_uid, '<table class=\"canonical-table\"><thead><tr>" + "".join(f"<th>{h}</th>" for h in X.HEADERS) + "</tr></thead><tbody>' || string_agg(line, '' ORDER BY row) || '</tbody></table>' AS html FROM "
    f"(SELECT table_uid, row, '<tr>' || string_agg('<td>' || text || '</td>', '' ORDER BY col) || '</tr>' AS line FROM ({T1}) GROUP BY table_uid, row) GROUP BY table_uid",
)
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.html(cells(spark, sf_dir)[0], named(spark, sf_dir))


@query("table_content_hash", f"SELECT table_uid, sha256(string_agg(lower(text), '|' ORDER BY row, col)) AS content_hash FROM ({T1}) WHERE trim(text) <> '' GROUP BY table_uid")
def table_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.content_hash(cells(spark, sf_dir)[0])


_WEIGHT = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(L.BACKEND_WEIGHTS.values())) + " END"


@query(
    "best_candidates",
    f"WITH c AS (SELECT p_partkey % 50 AS grp, p_partkey AS id, round(0.40 * p_size / 50.0 + 0.30 * (p_partkey % 3) / 2.0 + 0.20 * {_WEIGHT} + 0.10 * (p_partkey % 3) / 2.0, 6) AS score FROM part) "
    "SELECT grp, id, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS k FROM c) WHERE k = 1",
)
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    backend = F.element_at(F.array(*map(F.lit, L.BACKEND_WEIGHTS)), (k % 5 + 1).cast("int"))
    head = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.when(i < k % 3, "level").otherwise("column_1"))
    c = spark.read.parquet(f"{sf_dir}/part.parquet").select((k % 50).alias("grp"), k.alias("id"), (F.col("p_size") / 50.0).alias("confidence"), head.alias("headers"), F.lit(2).alias("n_cols"), backend.alias("backend"))
    return shapes.best_candidates(c.withColumn("score", F.round(shapes.candidate_score(), 6)), "grp").select("grp", "id", F.round(shapes.candidate_score(), 6).alias("score"))


_BARE = f"SELECT table_uid, row, col, CASE WHEN row % 2 = 1 THEN regexp_replace(text, ' (V/m|MHz)$', '') ELSE text END AS text FROM ({T1})"


@query(
    "fact_cells",
    "SELECT table_uid, row, col, CASE col WHEN 2 THEN 'FieldStrength' ELSE 'FrequencyRange' END AS semantic_key, CASE col WHEN 2 THEN 'field_strength' ELSE 'frequency_range' END AS fact_type, "
    "CASE WHEN col = 3 AND row % 2 = 0 THEN CAST(1000000 * CAST(split_part(text, ' ', 1) AS BIGINT) AS VARCHAR) || '.0' ELSE split_part(text, ' ', 1) END AS value, CASE col WHEN 2 THEN 'V/m' ELSE 'Hz' END AS unit, "
    f"CASE WHEN row % 2 = 1 THEN 0.75 WHEN col = 2 THEN 0.95 ELSE 0.85 END AS confidence FROM ({_BARE}) WHERE col >= 2",
)
def fact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other row has bare numbers, in the units of their headers."""
    bare = F.when(F.col("row") % 2 == 1, F.regexp_replace("text", " (V/m|MHz)$", "")).otherwise(F.col("text"))
    found = shapes.fact_cells(cells(spark, sf_dir)[0].withColumn("text", bare), named(spark, sf_dir))
    facts = found.select("table_uid", "row", "col", "semantic_key", F.explode("facts").alias("f"))
    return facts.select("table_uid", "row", "col", "semantic_key", *[f"f.{c}" for c in ("fact_type", "value", "unit", "confidence")])


@query(
    "table_test_types",
    "SELECT DISTINCT table_uid, CASE WHEN CAST(split_part(table_uid, ' ', 2) AS BIGINT) % 3 = 0 THEN 'esd' WHEN CAST(split_part(table_uid, ' ', 2) AS BIGINT) % 3 = 1 THEN 'radiated_immunity' ELSE 'unknown' END AS test_type "
    f"FROM ({T1})",
)
def table_test_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third table tells its test in the caption, every other third in its section."""
    k = F.split("table_uid", " ")[1].cast("long") % 3
    plain = cells(spark, sf_dir)[0].select("table_uid").distinct().withColumn("headers", F.array(F.lit("Value"), F.lit("Unit")))
    return shapes.table_test_types(plain.withColumns({"caption": F.when(k == 0, "ESD"), "section": F.when(k < 2, "RS tests").otherwise("Log")}))
