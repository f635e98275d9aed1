"""Queries of alignment, severity and change records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import text as T
from clauseforge.operators import changes, matching, metrics, severity
from clauseforge.plans import fixtures as X
from clauseforge.plans.catalog import query
from clauseforge.plans.text_queries import C1, C2, FLAGS_SQL, _numeric_pairs, entity_sql, q, strength_sql, verb_sql


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return X.sql(spark, sf_dir, X.CLAUSES_V1), X.sql(spark, sf_dir, X.CLAUSES_V2)


@query(
    "stable_id_match",
    f"SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'ADDED' WHEN b.node IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, a.section AS l_section, b.section AS r_section FROM ({C1}) a FULL JOIN ({C2}) b ON a.node = b.node",
)
def stable_id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.align(*versions(spark, sf_dir)).select("node", "change_type", "l_section", "r_section")


_STOP = ", ".join(q(w) for w in T.stopwords())
_TOK = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains([{_STOP}], t)))"
_JOINED = (
    "SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'ADDED' WHEN b.node IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change_type, "
    f"a.section AS ls, b.section AS rs, coalesce(a.text, '') AS lt, coalesce(b.text, '') AS rt FROM ({C1}) a FULL JOIN ({C2}) b ON a.node = b.node"
)
_SIGNALS = (
    f"SELECT *, change_type = 'MODIFIED' AS paired, {FLAGS_SQL}, {verb_sql('lt')} AS lv, {verb_sql('rt')} AS rv, len(gone) + len(come) AS n_diff, greatest(len(gone), len(come)) AS n_num, "
    f"{entity_sql('lt || chr(32) || rt')} AS entity_type, CASE WHEN change_type = 'MODIFIED' THEN round(1.0 - len(list_intersect({_TOK('lt')}, {_TOK('rt')})) / len(list_distinct(list_concat({_TOK('lt')}, {_TOK('rt')}))), 6) END AS distance "
    f"FROM ({_numeric_pairs(_JOINED)})"
)
_CONTEXT = (
    f"SELECT node, change_type, CASE WHEN paired AND ls <> rs THEN 'moved' ELSE 'same' END AS alignment_type, coalesce(ls, rs) AS section, lt, rt, distance, paired AND formatting_only AS formatting_only, "
    "paired AND reference_only AS reference_only, paired AND cosmetic AS cosmetic, CASE WHEN paired THEN n_num ELSE 0 END AS n_numeric, entity_type, "
    f"CASE WHEN paired AND lv <> rv THEN CASE WHEN {strength_sql('rv')} > {strength_sql('lv')} THEN 'strengthened' WHEN {strength_sql('rv')} < {strength_sql('lv')} THEN 'weakened' ELSE 'changed' END END AS verb_direction "
    f"FROM ({_SIGNALS})"
)
_MEANING = f"SELECT *, CASE WHEN change_type <> 'MODIFIED' OR formatting_only THEN 'unchanged' WHEN verb_direction IS NOT NULL THEN verb_direction WHEN 1.0 - distance < 0.75 AND NOT cosmetic THEN 'changed' ELSE 'unchanged' END AS meaning_change FROM ({_CONTEXT})"
_HASH = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_KEPT = (
    f"SELECT * FROM ({_MEANING}) WHERE change_type <> 'MODIFIED' OR NOT (alignment_type <> 'moved' AND meaning_change = 'unchanged' AND ((distance <= 0.20 AND NOT cosmetic) OR {_HASH('lt')} = {_HASH('rt')}))"
)


def severity_sql(source: str, department: str = "") -> str:
    """The ladder's severity for a source without table changes or labels."""
    obligation = "(verb_direction IS NOT NULL OR meaning_change IN ('weakened', 'strengthened', 'inverted'))"
    content = "(meaning_change NOT IN ('unchanged', '') OR n_numeric > 0)"
    expert = f"change_type = 'MODIFIED' AND NOT (formatting_only AND n_numeric = 0) AND NOT (cosmetic AND NOT {content}) AND (coalesce(verb_direction = 'weakened', false) OR n_numeric > 0)"
    return (
        f"SELECT *, CASE WHEN reference_only THEN 'low' WHEN formatting_only THEN 'low' WHEN change_type = 'MODIFIED' AND cosmetic AND NOT {obligation} AND NOT {content} THEN 'low' "
        f"WHEN change_type IN ('ADDED', 'REMOVED') THEN 'high' {'WHEN ' + expert + chr(32) + 'THEN ' + q('high') if department else ''} WHEN {obligation} THEN 'medium' WHEN distance > 0.75 THEN 'high' "
        f"WHEN alignment_type = 'moved' THEN 'medium' WHEN {content} OR distance > 0.35 THEN 'medium' WHEN entity_type <> '' THEN 'high' ELSE 'low' END AS severity FROM ({source})"
    )


def records(spark: SparkSession, sf_dir: str, meanings: bool = False, department: str = "") -> DataFrame:
    return changes.change_records(*versions(spark, sf_dir), meanings=meanings, department=department)


_COLUMNS = "node, change_type, alignment_type, section, distance, meaning_change, verb_direction, n_numeric, cosmetic, formatting_only, reference_only, entity_type"


def _flat(r: DataFrame) -> DataFrame:
    return r.select(*_COLUMNS.split(", "), F.col("verdict.severity").alias("severity"))


@query("change_records", f"SELECT {_COLUMNS}, severity FROM ({severity_sql(_KEPT)})")
def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: what changed between two versions, with its severity."""
    return _flat(records(spark, sf_dir))


@query("change_records_emc", f"SELECT {_COLUMNS}, severity FROM ({severity_sql(_KEPT, 'EMC')})")
def change_records_emc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records(spark, sf_dir, department="EMC"))


@query("change_records_meanings")
def change_records_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir, meanings=True)
    return r.select("change_id", "change_type", "meaning_change", "distance", "confidence", "verdict.severity", "verdict.reasons", "verdict.impact", "verdict.codes", "verdict.disposition", severity.needs_review(F.col("verdict")).alias("review"))


@query("severity_ladder", f"SELECT node, severity FROM ({severity_sql(_MEANING)})")
def severity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = changes.signals(changes.align(*versions(spark, sf_dir)), meanings=False)
    return s.select("node", severity.classify()["severity"].alias("severity"))


@query(
    "diff_filter_sorted",
    f"SELECT node, severity, row_number() OVER (PARTITION BY section ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, node) AS place FROM ({severity_sql(_KEPT)}) QUALIFY severity <> 'low'",
)
def diff_filter_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without low ones, ranked in their section by severity.  Low ones rank last,
    so they are left out after ranking, which keeps the filter off the rules."""
    w = W.partitionBy("section").orderBy(changes.severity_order(F.col("severity")), "node")
    ranked = _flat(records(spark, sf_dir)).select("node", "severity", F.row_number().over(w).alias("place"))
    return ranked.where("severity <> 'low'")


@query("severity_rollup", f"SELECT change_type, severity, count(*) AS n FROM ({severity_sql(_KEPT)}) GROUP BY ROLLUP (change_type, severity)")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records(spark, sf_dir)).rollup("change_type", "severity").agg(F.count("*").alias("n"))


_MATCHES = f"SELECT section, distance FROM ({_MEANING}) WHERE change_type = 'MODIFIED'"
_SUM = "round(avg(distance), 4) AS avg_distance, round(avg(1 - distance), 4) AS avg_score, count(*) AS n, round(avg(CASE WHEN distance <= 0.20 THEN 1.0 WHEN distance <= 0.35 THEN 0.7 ELSE 0.3 END), 4) AS confidence"


@query("section_accuracy", f"SELECT section, {_SUM} FROM ({_MATCHES}) GROUP BY section")
def section_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = changes.signals(changes.align(*versions(spark, sf_dir)), meanings=False).where("change_type = 'MODIFIED'")
    return metrics.match_accuracy(s.select(F.coalesce("l_section", "r_section").alias("section"), "distance"), "section")


@query("overall_accuracy", f"SELECT {_SUM} FROM ({_MATCHES})")
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = changes.signals(changes.align(*versions(spark, sf_dir)), meanings=False).where("change_type = 'MODIFIED'")
    return metrics.match_accuracy(s.select("distance"))


@query("no_change_coverage", f"SELECT section, count(*) FILTER (WHERE distance < 0.20) AS same, count(*) AS n, round(count(*) FILTER (WHERE distance < 0.20) / count(*), 4) AS share FROM ({_MATCHES}) GROUP BY section")
def no_change_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = changes.signals(changes.align(*versions(spark, sf_dir)), meanings=False).where("change_type = 'MODIFIED'")
    s = s.select(F.coalesce("l_section", "r_section").alias("section"), "distance").groupBy("section")
    return s.agg(F.count_if(F.col("distance") < 0.20).alias("same"), F.count("*").alias("n")).withColumn("share", F.round(F.col("same") / F.col("n"), 4))


@query("trace_counts", f"SELECT change_type, meaning_change, count(*) AS n FROM ({_MEANING}) GROUP BY ALL")
def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = changes.signals(changes.align(*versions(spark, sf_dir)), meanings=False)
    return s.groupBy("change_type", "meaning_change").agg(F.count("*").alias("n"))


@query(
    "diff_events",
    f"SELECT node, seq, event, payload FROM (SELECT node, row_number() OVER (PARTITION BY section ORDER BY node) AS seq, severity, section FROM ({severity_sql(_KEPT)})) r, "
    "LATERAL (VALUES ('diff_start', section), ('diff_complete', severity)) AS e(event, payload)",
)
def diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a stream of differences is made of, in order by section."""
    r = _flat(records(spark, sf_dir)).withColumn("seq", F.row_number().over(W.partitionBy("section").orderBy("node")))
    events = F.array(F.struct(F.lit("diff_start").alias("event"), F.col("section").alias("payload")), F.struct(F.lit("diff_complete").alias("event"), F.col("severity").alias("payload")))
    return r.select("node", "seq", F.inline(events))


@query("section_buckets", f"SELECT section, count(*) AS n, min(page) AS first_page, sum(len(text)) AS size, dense_rank() OVER (ORDER BY min(page), section) AS place FROM ({C1}) GROUP BY section")
def section_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their sizes, ranked by where they begin; the rank runs over
    sections, of which there are few."""
    s = X.sql(spark, sf_dir, X.CLAUSES_V1).groupBy("section").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.sum(F.length("text")).alias("size"))
    return s.withColumn("place", F.dense_rank().over(W.orderBy("first_page", "section")))


@query("section_prefix_tree", f"SELECT p.path, p.depth, p.parent, count(*) AS n FROM (SELECT section, string_split(section, ' / ') AS s FROM ({C1})) c, LATERAL (VALUES (s[1], 1, NULL), (section, 2, s[1])) AS p(path, depth, parent) GROUP BY ALL")
def section_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's ancestors by the prefixes of its path."""
    parts = F.split("section", " / ")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), " / ").alias("path"), k.alias("depth"), F.when(k > 1, F.array_join(F.slice(parts, 1, k - 1), " / ")).alias("parent")))
    return X.sql(spark, sf_dir, X.CLAUSES_V1).select(F.inline(prefix)).groupBy("path", "depth", "parent").agg(F.count("*").alias("n"))


@query("graph_edges", f"SELECT section AS parent, node, row_number() OVER (PARTITION BY section ORDER BY page, node) AS ordinal FROM ({C1})")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_CHILD edges from sections to clauses, with their ordinals."""
    w = W.partitionBy("section").orderBy("page", "node")
    return X.sql(spark, sf_dir, X.CLAUSES_V1).select(F.col("section").alias("parent"), "node", F.row_number().over(w).alias("ordinal"))


@query("subgraph_delete", f"SELECT count(*) AS deleted, count(DISTINCT section) AS sections FROM ({C1}) WHERE section LIKE 'BUILDING / %'")
def subgraph_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.sql(spark, sf_dir, X.CLAUSES_V1).where(F.col("section").startswith("BUILDING / "))
    return c.agg(F.count("*").alias("deleted"), F.countDistinct("section").alias("sections"))


@query("clause_greedy_match")
def clause_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clauses, matched by score within their section as if they had no ids."""
    return matching.match_blocks(*versions(spark, sf_dir), "section")


@query("moves")
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses without an equal one in their section, matched across the sections of a
    nation."""
    left, right = (v.withColumn("place", F.element_at(F.split("section", " / "), -1)) for v in versions(spark, sf_dir))
    return matching.moves(left.join(right, ["section", "text"], "left_anti"), right.join(left, ["section", "text"], "left_anti"), "place")


@query("similar_lines")
def similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character similarity of the two versions of each clause."""
    p = changes.align(*versions(spark, sf_dir)).where("change_type = 'MODIFIED' and l_text <> r_text")
    return p.select("node", F.round(matching.ratio(F.col("l_text"), F.col("r_text")), 6).alias("ratio"), matching.is_label_change(F.col("l_text"), F.col("r_text")).alias("label_change"))
