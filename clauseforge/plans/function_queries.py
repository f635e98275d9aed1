"""Queries of single functions and rules, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.functions import labels, lexicon as L
from clauseforge.functions import semantics as S
from clauseforge.functions import text as T
from clauseforge.operators import nodes, records, severity, shapes, tables
from clauseforge.plans import fixtures as X
from clauseforge.plans.catalog import query
from clauseforge.plans.record_queries import _ALIGNED, aligned
from clauseforge.plans.text_queries import C1, collapsed, q
from clauseforge.sources import stores

_H = "(SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_orderkey * 31 + l_linenumber * 7 AS h, l_quantity AS quantity, l_extendedprice AS price FROM {lineitem}) t"
#: A context of a change for each line of an order.
CONTEXTS = (
    "SELECT k, n, CASE WHEN h % 9 = 0 THEN 'ADDED' WHEN h % 9 = 1 THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, "
    "CASE h % 7 WHEN 0 THEN 'moved' WHEN 1 THEN 'split' WHEN 2 THEN 'merged' ELSE 'matched' END AS alignment_type, CASE WHEN h % 4 = 0 THEN 'table' ELSE 'paragraph' END AS node_type, "
    "CAST(h % 20 AS DOUBLE) / 20 AS distance, CASE k % 8 WHEN 0 THEN 'weakened' WHEN 1 THEN 'strengthened' WHEN 2 THEN 'modified' ELSE 'unchanged' END AS meaning_change, "
    "CAST(CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END AS INT) AS n_numeric, CASE h % 11 WHEN 0 THEN 'weakened' WHEN 1 THEN 'strengthened' END AS verb_direction, "
    "CAST(CASE WHEN h % 6 = 0 THEN 2 ELSE 0 END AS INT) AS n_table, k % 3 = 0 AS cosmetic, h % 13 = 0 AS reference_only, k % 6 < 2 AS formatting_only, h % 17 = 0 AS structural_label, "
    "CASE k % 10 WHEN 0 THEN 'FieldStrength' WHEN 1 THEN 'TestMethod' ELSE '' END AS entity_type, h % 12 = 0 AS procedure_change, h % 14 < 2 AS setup_change, "
    f"CASE n % 5 WHEN 0 THEN 'EMC' WHEN 1 THEN 'Safety' WHEN 2 THEN 'Environment' WHEN 3 THEN 'EMV' ELSE 'Quality' END AS department FROM {_H}"
)
_SAID = "(verb_direction IS NOT NULL OR meaning_change IN ('weakened', 'strengthened', 'inverted'))"
_CONTENT = "(meaning_change NOT IN ('unchanged', '') OR n_numeric > 0 OR n_table > 0)"
_WEAKER = "coalesce(verb_direction = 'weakened', false)"
_EXPERT = f"change_type = 'MODIFIED' AND NOT ((formatting_only AND n_numeric = 0) OR (cosmetic AND NOT {_CONTENT})) AND upper(department) IN "
#: By rule the severities it gives, as (condition, severity), the first that holds.
_RULES = {
    "structural_label": [("structural_label AND change_type = 'MODIFIED'", "low")],
    "reference_number_only": [("reference_only", "low")],
    "formatting_only": [("formatting_only", "low")],
    "cosmetic_only": [(f"change_type = 'MODIFIED' AND cosmetic AND NOT {_SAID} AND NOT {_CONTENT}", "low")],
    "added_removed": [("change_type IN ('ADDED', 'REMOVED')", "high")],
    "emc_expert": [(f"{_EXPERT} ('EMC', 'EMV') AND ({_WEAKER} OR n_numeric > 0 OR (node_type = 'table' AND n_table > 0))", "high")],
    "safety_expert": [(f"{_EXPERT} ('SAFETY') AND ({_WEAKER} OR n_numeric > 0 OR procedure_change)", "high")],
    "environmental_expert": [(f"{_EXPERT} ('ENVIRONMENT', 'ENVIRONMENTAL') AND ({_WEAKER} OR n_numeric > 0 OR setup_change OR procedure_change)", "high")],
    "obligation_change": [(_SAID, "medium")],
    "high_distance": [("distance > 0.75", "high")],
    "moved": [("alignment_type = 'moved'", "medium")],
    "split_merge": [(f"alignment_type IN ('split', 'merged') AND NOT {_SAID} AND NOT {_CONTENT} AND distance <= 0.35", "low"), ("alignment_type IN ('split', 'merged')", "medium")],
    "content_change": [(f"{_CONTENT} OR distance > 0.35", "medium")],
    "domain_entity": [("entity_type IN ('FieldStrength', 'FrequencyRange', 'EmissionLimit', 'AcceptanceCriterion', 'TestMethod')", "high")],
    "obligation_escalation": [(_WEAKER, "medium")],
    "obligation_strengthened": [("verb_direction = 'strengthened'", "medium")],
    "presentation_only": [("cosmetic AND formatting_only", "low")],
    "test_procedure": [("change_type = 'MODIFIED' AND procedure_change AND meaning_change NOT IN ('unchanged', '')", "high")],
    "test_setup": [("change_type = 'MODIFIED' AND setup_change AND meaning_change NOT IN ('unchanged', '')", "medium")],
    "fallback": [("true", "low")],
}


def _rule_sql(name: str) -> str:
    case = " ".join(f"WHEN {c} THEN '{s}'" for c, s in _RULES[name])
    return f"SELECT '{name}' AS rule, CASE {case} END AS severity FROM ({X.plain(CONTEXTS)})"


@query("severity_rules_alone", f"SELECT rule, severity, count(*) AS n FROM ({' UNION ALL '.join(map(_rule_sql, _RULES))}) WHERE severity IS NOT NULL GROUP BY rule, severity")
def severity_rules_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule fires by itself, and with what severity."""
    df = severity.with_context(X.sql(spark, sf_dir, CONTEXTS))
    fired = [F.struct(F.lit(r.__name__).alias("rule"), r()["severity"].alias("severity")) for r in severity.RULES]
    each = df.select(F.explode(F.filter(F.array(*fired), lambda x: x["severity"].isNotNull())).alias("x"))
    return each.groupBy("x.rule", "x.severity").agg(F.count("*").alias("n"))


_FIRST = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for name, cases in _RULES.items() for c in [" OR ".join(f"({x})" for x, _ in cases)]) + " END"


@query("severity_first_rule", f"SELECT rule, count(*) AS n FROM (SELECT {_FIRST} AS rule FROM ({X.plain(CONTEXTS)})) GROUP BY rule")
def severity_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which rule changes are classified."""
    df = severity.with_context(X.sql(spark, sf_dir, CONTEXTS))
    first = F.coalesce(*[F.when(r().isNotNull(), r.__name__) for r in severity.RULES])
    return df.groupBy(first.alias("rule")).agg(F.count("*").alias("n"))


_KB = "CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0::DOUBLE) ELSE printf('%.1f MB', n_chars / 1048576.0::DOUBLE) END"


@query("short_texts", f"SELECT doc_id, CASE WHEN length(t) > 90 THEN rtrim(substr(t, 1, 90)) || '...' ELSE t END AS short, {_KB} AS size FROM (SELECT doc_id, n_chars, {collapsed('text')} AS t FROM documents)")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.short(F.col("text")).alias("short"), T.human_size(F.col("n_chars")).alias("size"))


_ANSWERS = (
    "SELECT node, '<think>' || section || chr(10) || '</think>1. ' || text || chr(10) || '2) What of ' || section || '?' || chr(10) || chr(10) || CASE WHEN node % 4 = 0 THEN '- and page 7' ELSE '<think>never closed' END AS answer, "
    f"CASE node % 3 WHEN 0 THEN '(No change)' WHEN 1 THEN ' no semantic change. ' ELSE ' ' || text END AS told FROM ({X.CLAUSES_V1}) c"
)
_BARE = "regexp_replace(answer, '<think>.*?(?:</think>|$)', '', 'gs')"
_ASKED = f"list_filter(list_transform(string_split_regex({_BARE}, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(trim(x), '^\\d*\\.*\\)*-*•*', ''))), lambda x: x <> '')[1:4]"


@query(
    "model_answers",
    f"SELECT node, len(asked) AS n_asked, array_to_string(asked, '|') AS asked, CASE WHEN trim(lower(trim(told)), '().') IN ({', '.join(map(q, L.NO_CHANGE))}) THEN '' ELSE trim(told) END AS told "
    f"FROM (SELECT node, told, {_ASKED} AS asked FROM ({X.plain(_ANSWERS)}))",
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model without thoughts, as questions; and what it says of a change."""
    a = X.sql(spark, sf_dir, _ANSWERS).withColumn("asked", labels.questions(T.without_thoughts(F.col("answer"))))
    return a.select("node", F.size("asked").cast("long").alias("n_asked"), F.array_join("asked", "|").alias("asked"), labels.told_change(F.col("told")).alias("told"))


_GERMAN = (
    "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderkey AS STRING) || ',5' WHEN 1 THEN '1.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ',25' "
    "WHEN 2 THEN '-2.500.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') WHEN 3 THEN ' 1 000 ' || CAST(o_orderkey AS STRING) ELSE o_orderpriority END AS said FROM {orders}"
)
_DIGITS = "regexp_replace(said, '\\s+', '', 'g')"


@query("german_numbers", f"SELECT k, TRY_CAST(replace(CASE WHEN regexp_matches(t, '^[+-]?\\d{{1,3}}(\\.\\d{{3}})+(,\\d+)?$') THEN replace(t, '.', '') ELSE t END, ',', '.') AS DOUBLE) AS value FROM (SELECT k, {_DIGITS} AS t FROM ({X.plain(_GERMAN)}))")
def german_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sql(spark, sf_dir, _GERMAN).select("k", T.german_number(F.col("said")).alias("value"))


_BOXES = (
    "SELECT k, n, quantity AS l, quantity + 40 AS r, h % 700 AS t, h % 700 + 60 AS b, CASE WHEN h % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(792 AS DOUBLE) END AS height, h % 2 = 0 AS bottom_left, "
    f"CAST(h % 50 AS DOUBLE) AS dx, CAST(h % 70 AS DOUBLE) AS dy FROM {_H}"
)


@query(
    "page_boxes",
    "SELECT k, n, l AS box_left, CASE WHEN bottom_left THEN coalesce(height, 842) - t ELSE t END AS box_top, CASE WHEN bottom_left THEN coalesce(height, 842) - b ELSE b END AS box_bottom, "
    f"round(greatest(0, 40 - dx) * greatest(0, 60 - dy) / (4800 - greatest(0, 40 - dx) * greatest(0, 60 - dy)), 9) AS iou FROM ({X.plain(_BOXES)})",
)
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as a viewer wants them, and how much each overlaps one that is moved."""
    box = F.struct(F.col("l"), F.col("t").cast("double").alias("t"), F.col("r"), F.col("b").cast("double").alias("b"))
    seen = labels.viewer_box(box, F.col("height"), F.col("bottom_left"))
    at = lambda dx, dy: F.struct((F.col("l") + dx).alias("x0"), (F.col("t") + dy).alias("y0"), (F.col("r") + dx).alias("x1"), (F.col("b") + dy).alias("y1"))
    iou = F.round(tables.iou(at(F.lit(0.0), F.lit(0.0)), at(F.col("dx"), F.col("dy"))), 9)
    return X.sql(spark, sf_dir, _BOXES).select("k", "n", seen["left"].alias("box_left"), seen["top"].alias("box_top"), seen["bottom"].alias("box_bottom"), iou.alias("iou"))


_GRIDS = f"SELECT k, n, CAST(h % 120 AS INT) AS n_rows, CAST(h % 25 AS INT) AS n_cols, CAST(FLOOR((h % 120) * (h % 25) * (n % 8) / 7) AS INT) AS n_filled FROM {_H}"
_FILL = "coalesce(n_filled::DOUBLE / nullif(n_rows * n_cols, 0), 0)"


@query(
    "grid_confidence",
    "SELECT k, n, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(0.5::DOUBLE + CASE WHEN n_rows < 2 THEN -0.2 ELSE 0 END::DOUBLE + CASE WHEN n_cols < 2 THEN -0.2 ELSE 0 END::DOUBLE + "
    f"CASE WHEN n_rows BETWEEN 2 AND 100 AND n_cols BETWEEN 2 AND 20 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN fill < 0.3 THEN -0.3 WHEN fill > 0.7 THEN 0.1 ELSE 0 END::DOUBLE, 6))) AS confidence FROM (SELECT *, {_FILL} AS fill FROM ({X.plain(_GRIDS)}))",
)
def grid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.sql(spark, sf_dir, _GRIDS)
    return g.select("k", "n", labels.extraction_confidence(F.col("n_rows"), F.col("n_cols"), F.col("n_filled")).alias("confidence"))


_RANGES = f"SELECT k, n, CAST(h % 40 AS DOUBLE) AS low, CAST(h % 40 + 60 AS DOUBLE) AS high, CAST(h % 40 + k % 3 - 1 AS DOUBLE) AS low_now, CAST(h % 40 + 59 + n % 3 AS DOUBLE) AS high_now FROM {_H}"
_WIDER, _NARROWER = "low_now <= low AND high_now >= high", "low_now >= low AND high_now <= high"


@query("range_changes", f"SELECT k, n, 'frequency_range_' || CASE WHEN {_WIDER} AND {_NARROWER} THEN 'unchanged' WHEN {_WIDER} THEN 'expanded' WHEN {_NARROWER} THEN 'restricted' ELSE 'shifted' END AS change FROM ({X.plain(_RANGES)})")
def range_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda a, b: F.struct(F.col(a).alias("low"), F.col(b).alias("high"))
    return X.sql(spark, sf_dir, _RANGES).select("k", "n", labels.range_change(pair("low", "high"), pair("low_now", "high_now")).alias("change"))


_KINDS = "CASE {0} % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list_item' WHEN 3 THEN 'heading' WHEN 4 THEN 'note' WHEN 5 THEN 'clause' END"
_PAIRS = f"SELECT k, n, {_KINDS.format('h')} AS a, {_KINDS.format('k')} AS b, CAST(h % 4 AS INT) AS depth_a, CAST(k % 4 AS INT) AS depth_b FROM {_H}"
_TEXTS = "('clause', 'paragraph', 'list_item', 'definition', 'note', 'warning')"


@query(
    "node_compatibility",
    f"SELECT k, n, coalesce(a, 'paragraph') = coalesce(b, 'paragraph') OR (coalesce(a, 'paragraph') IN {_TEXTS} AND coalesce(b, 'paragraph') IN {_TEXTS}) AS compatible, "
    f"CASE WHEN depth_a = depth_b THEN 1.0::DOUBLE WHEN abs(depth_a - depth_b) = 1 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS depth FROM ({X.plain(_PAIRS)})",
)
def node_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.sql(spark, sf_dir, _PAIRS)
    return p.select("k", "n", labels.compatible(F.col("a"), F.col("b")).alias("compatible"), labels.depth_score(F.col("depth_a"), F.col("depth_b")).alias("depth"))


_TOLD = f"SELECT node, CASE node % 7 WHEN 0 THEN ' EMC ' WHEN 1 THEN 'Safety' WHEN 2 THEN 'Environment' WHEN 3 THEN 'safety' END AS who, CASE node % 5 WHEN 0 THEN 'never: ' WHEN 1 THEN 'Optional, ' WHEN 2 THEN 'Mandatory. ' ELSE '' END || text AS said FROM ({X.CLAUSES_V1}) c"
_FORBIDS = "regexp_matches(t, 'not|never|prohibit|forbid')"


@query(
    "obligation_values",
    f"SELECT node, CASE WHEN trim(coalesce(who, '')) IN ('EMC', 'Safety', 'Environment') THEN trim(who) ELSE 'EMC' END AS department, coalesce(CASE WHEN contains(t, 'shall') AND {_FORBIDS} THEN 'shall_not' WHEN contains(t, 'must') AND {_FORBIDS} THEN 'must_not' "
    "WHEN regexp_matches(t, 'prohibit|forbid') THEN 'must_not' WHEN contains(t, 'shall') THEN 'shall' WHEN contains(t, 'must') THEN 'must' WHEN regexp_matches(t, 'require|mandatory|obligat') THEN 'required' "
    f"WHEN contains(t, 'recommend') THEN 'recommended' WHEN contains(t, 'should') THEN 'should' WHEN regexp_matches(t, 'may|optional') THEN 'may' END, '') AS obligation FROM (SELECT node, who, lower(said) AS t FROM ({X.plain(_TOLD)}))",
)
def obligation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.sql(spark, sf_dir, _TOLD)
    return t.select("node", labels.department(F.col("who")).alias("department"), F.coalesce(labels.obligation_value(F.col("said")), F.lit("")).alias("obligation"))


_RUNNING = (
    "SELECT node, CASE node % 6 WHEN 0 THEN ' ' || CAST(page AS STRING) || ' von 97 ' WHEN 1 THEN 'Seite ' || CAST(page AS STRING) WHEN 2 THEN 'Company Confidential, ' || section WHEN 3 THEN text "
    "WHEN 4 THEN 'KD ' || CAST(node AS STRING) ELSE '- - ' || text END AS said, node % 4 < 2 AS is_item, "
    "CASE node % 5 WHEN 0 THEN ' Foreword' WHEN 1 THEN 'Annex ' || section WHEN 2 THEN 'Annex, Tabelle 4a ' || section WHEN 3 THEN 'Revision History' ELSE section END AS title "
    f"FROM ({X.CLAUSES_V1}) c"
)
_SECRET = " OR ".join(f"contains(lower(t), {q(x)})" for x in L.CONFIDENTIALITY)


@query(
    "running_texts",
    f"SELECT node, t <> '' AND length(t) <= 200 AND (regexp_matches(t, {q('(?i)' + L.PAGE_NUMBER)}) OR {_SECRET}) AS header_footer, t <> '' AND length(t) <= 12 AND length(regexp_replace(t, '\\D', '', 'g')) >= 0.6 * length(t) AS code, "
    "CASE WHEN is_item AND node % 6 = 5 THEN substr(said, 5) ELSE trim(said) END AS item, "
    f"regexp_matches(title, {q('(?i)' + L.SKIPPED_SECTIONS)}) AS skipped, regexp_matches(title, {q('(?i)' + L.REFERENCE_SECTION)}) AND NOT regexp_matches(title, {q('(?i)' + L.TABLE_NUMBER)}) AS reference "
    f"FROM (SELECT *, trim(said) AS t FROM ({X.plain(_RUNNING)}))",
)
def running_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of running headers, footers and codes, list markers and titles of sections."""
    r, said = X.sql(spark, sf_dir, _RUNNING), F.col("said")
    return r.select(
        "node", T.is_header_footer(said).alias("header_footer"), labels.is_running_code(said).alias("code"), F.trim(labels.list_text(said, F.col("is_item"))).alias("item"),
        S.is_skipped_section(F.col("title")).alias("skipped"), labels.is_reference_section(F.array("title"), F.lit(True)).alias("reference"),
    )


@query("anchor_texts", f"SELECT node, CASE WHEN marker <> '' THEN lower(trim(marker)) ELSE array_to_string(string_split({collapsed('lower(said)')}, ' ')[1:12], ' ') END AS anchor, kind IN ('clause', 'table') AND exclusion IS NULL AS indexable FROM (SELECT *, regexp_extract(said, '(?i)^\\s*((?:section|clause|article|appendix|annex)?\\s*[A-Za-z]?\\d+(?:\\.\\d+)*[A-Za-z]?)\\b', 1) AS marker FROM (SELECT node, CASE node % 4 WHEN 0 THEN 'Section ' || CAST(page AS VARCHAR) || '.2 ' ELSE '' END || text AS said, CASE node % 3 WHEN 0 THEN 'clause' WHEN 1 THEN 'table' ELSE 'section' END AS kind, CASE WHEN node % 7 = 0 THEN 'table_of_contents' END AS exclusion FROM ({C1})))")
def anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers or first words of clauses, and whether they are indexed."""
    c = X.sql(spark, sf_dir, X.CLAUSES_V1).selectExpr(
        "node", "CASE node % 4 WHEN 0 THEN 'Section ' || CAST(page AS STRING) || '.2 ' ELSE '' END || text AS said", "CASE node % 3 WHEN 0 THEN 'clause' WHEN 1 THEN 'table' ELSE 'section' END AS kind",
        "CASE WHEN node % 7 = 0 THEN 'table_of_contents' END AS exclusion",
    )
    return c.select("node", T.anchor(F.col("said")).alias("anchor"), nodes.is_indexable(F.col("kind"), F.col("said"), F.col("exclusion")).alias("indexable"))


@query("evidence_sides", f"SELECT node, l_section AS old_section, CASE WHEN length(l_text) > 200 THEN rtrim(substr(l_text, 1, 200)) || '...' ELSE l_text END AS old_quote, r_section AS new_section, CASE WHEN length(r_text) > 200 THEN rtrim(substr(r_text, 1, 200)) || '...' ELSE r_text END AS new_quote FROM {_ALIGNED}")
def evidence_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = aligned(spark, sf_dir)
    side = lambda s: records.evidence(F.col(f"{s}_section"), F.col("page"), F.col(f"{s}_text"))
    e = a.select("node", side("l").alias("old"), side("r").alias("new"))
    return e.select("node", F.col("old.section").alias("old_section"), F.col("old.quote").alias("old_quote"), F.col("new.section").alias("new_section"), F.col("new.quote").alias("new_quote"))


@query("combined_nodes", f"SELECT section, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'paragraph' END AS node_type, string_agg(text, chr(10) || chr(10) ORDER BY page, ord, node) AS text, string_agg(CAST(node AS VARCHAR), ',' ORDER BY page, ord, node) AS nodes FROM (SELECT *, node % 10 AS ord, CASE WHEN section LIKE '%A' AND node % 3 = 0 THEN 'note' ELSE 'list_item' END AS kind FROM ({C1})) GROUP BY section")
def combined_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.sql(spark, sf_dir, X.CLAUSES_V1).drop("node_type")
    return records.combined(c.selectExpr("*", "node % 10 AS ord", "CASE WHEN section LIKE '%A' AND node % 3 = 0 THEN 'note' ELSE 'list_item' END AS node_type"), "section")


_HEADS = (
    "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'Annex' ELSE 'Limits' END AS section, p_partkey % 3 = 0 AS split, p_partkey % 7 = 0 AS split_now, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'Table' END AS caption, "
    "p_partkey % 11 = 0 AS turned, p_partkey % 13 = 0 AS gone, p_partkey % 17 = 0 AS come, CAST(p_size % 3 AS INT) AS n_rows, CAST(p_size % 4 AS INT) AS n_cells, CAST(p_size % 2 AS INT) AS n_modified FROM {part}"
)
_STRUCTURE = "list_filter([CASE WHEN section = 'Annex' THEN 'moved_section' END, CASE WHEN NOT split AND split_now THEN 'split_across_pages' WHEN split AND NOT split_now THEN 'merged_from_split' END, CASE WHEN caption <> 'Table' THEN 'caption_changed' END, CASE WHEN turned AND NOT gone AND NOT come THEN 'columns_reordered' END], lambda x: x IS NOT NULL)"
_KIND = (
    "CASE WHEN similarity > 0.99 AND len(s) = 0 THEN 'identical' WHEN list_contains(s, 'moved_section') THEN 'moved' WHEN list_contains(s, 'caption_changed') THEN 'renamed' "
    "WHEN list_contains(s, 'split_across_pages') OR list_contains(s, 'merged_from_split') THEN 'structural_changed' WHEN added <> '' OR removed <> '' THEN 'column_changed' WHEN n_rows > 0 THEN 'row_changed' WHEN n_modified > 0 THEN 'cell_changed' ELSE 'identical' END"
)


@query(
    "table_changes",
    f"SELECT k, array_to_string(s, ',') AS structural, added, removed, kind, CASE WHEN kind = 'identical' THEN 'identical' WHEN n_cells = 0 AND n_modified = 0 AND n_rows = 0 AND added = '' AND removed = '' AND len(list_filter(s, lambda x: x NOT IN ('caption_changed', 'moved_section'))) = 0 THEN 'low' "
    "WHEN n_rows > 0 AND n_cells < 5 THEN 'medium' WHEN n_cells > 0 OR n_modified > 0 THEN 'high' WHEN kind IN ('column_changed', 'row_changed') THEN 'medium' ELSE 'high' END AS impact "
    f"FROM (SELECT *, {_KIND} AS kind FROM (SELECT *, {_STRUCTURE} AS s, CASE WHEN come THEN 'Zulu' ELSE '' END AS added, CASE WHEN gone THEN 'Yankee' ELSE '' END AS removed, CASE WHEN n_rows + n_cells + n_modified = 0 AND NOT gone AND NOT come THEN 1.0 ELSE 0.8 END AS similarity FROM ({X.plain(_HEADS)})))",
)
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, structure, kind and impact of a table's difference."""
    h = X.sql(spark, sf_dir, _HEADS)
    names = lambda flag, *always: F.array_compact(F.array(*[F.lit(a) for a in always], flag))
    old = names(F.when(F.col("gone"), "Yankee"), "Alpha", "Bravo")
    new = names(F.when(F.col("come"), "Zulu"), "Alpha", "Bravo")
    new = F.when(F.col("turned"), F.reverse(new)).otherwise(new)
    side = lambda section, split, caption, heads: F.struct(section.alias("section"), split.alias("is_split"), caption.alias("caption"), heads.alias("headers"))
    s = shapes.structural_changes(side(F.lit("Limits"), F.col("split"), F.lit("Table"), old), side(F.col("section"), F.col("split_now"), F.col("caption"), new))
    d = h.withColumn("s", s).withColumn("c", shapes.column_changes(old, new)).withColumn("n_columns", F.size("c.added") + F.size("c.removed"))
    similarity = F.when((F.col("n_rows") + F.col("n_cells") + F.col("n_modified") + F.col("n_columns")) == 0, 1.0).otherwise(0.8)
    d = d.withColumn("kind", shapes.diff_type(similarity, F.col("s"), F.col("n_columns"), F.col("n_rows"), F.col("n_modified")))
    none = F.array().cast("array<string>")
    impact = shapes.impact(F.col("kind"), F.col("s"), none, F.col("n_columns"), F.col("n_rows"), F.col("n_modified"), F.col("n_cells"))
    return d.select("k", F.array_join("s", ",").alias("structural"), F.array_join("c.added", ",").alias("added"), F.array_join("c.removed", ",").alias("removed"), "kind", impact.alias("impact"))


_SPANS = "SELECT 'table ' || CAST(p_partkey % 50 AS STRING) AS table_uid, CAST((p_partkey - p_partkey % 50) / 50 AS INT) * 3 AS row, 0 AS col, CAST(p_size % 3 + 1 AS INT) AS row_span, CAST(p_size % 4 AS INT) AS col_span, p_brand AS text FROM {part}"


@query("spanned_cells", f"SELECT table_uid, row + r AS row, col + c AS col, text FROM (SELECT *, unnest(range(0, greatest(row_span, 1))) AS r FROM ({X.plain(_SPANS)})) t, range(0, 3) AS u(c) WHERE c < greatest(col_span, 1)")
def spanned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.span_grid(X.sql(spark, sf_dir, _SPANS)).select("table_uid", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


_FOLDERS = "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'data/_trash/m.json' ELSE 'data/doc' || CAST(o_orderkey AS STRING) || '/m.json' END AS path, o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '2024-01-01' END AS upload_date FROM {orders}"


@query("listed_documents", f"SELECT id, name FROM ({X.plain(_FOLDERS)}) WHERE path NOT LIKE 'data/\\_%' ESCAPE '\\' AND name <> '' AND upload_date IS NOT NULL")
def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.documents(X.sql(spark, sf_dir, _FOLDERS)).select("id", "name")


@query("cited_records", f"SELECT r.node, coalesce(CASE WHEN g.node % 4 = 0 THEN g.section END, r.section) AS section, coalesce(CASE WHEN g.node % 4 = 0 THEN g.page END, 7) AS page FROM (SELECT node, section FROM {_ALIGNED}) r LEFT JOIN ({C1}) g ON r.node = g.node")
def cited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the place that the graph knows, where it knows their node."""
    graph = X.sql(spark, sf_dir, X.CLAUSES_V1).where("node % 4 = 0").select("node", "section", "page")
    own = aligned(spark, sf_dir).select("node", "section", F.lit(7).cast("long").alias("page"))
    return stores.citations(own, graph).select("node", "section", F.col("page").cast("long").alias("page"))
