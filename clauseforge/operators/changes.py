"""Aligning two versions by stable ids and turning the pairs into change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import semantics as S
from clauseforge.functions import text as T
from clauseforge.operators import severity

SAME, REVIEWED = 0.20, 0.75


def unique_by(nodes: DataFrame, key: str) -> DataFrame:
    """The rows whose key no other row has; null keys are none."""
    single = nodes.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n = 1 and _k is not null")
    return nodes.join(single, nodes[key] == single["_k"], "left_semi")


def _side(nodes: DataFrame, mark: str, key: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(c if c == key else f"{mark}_{c}") for c in nodes.columns])


def align(left: DataFrame, right: DataFrame, key: str = "node") -> DataFrame:
    """One row for each matched, removed or added node: key, l_*, r_* and
    ``change_type``.  Keys that repeat on a side match nothing."""
    a, b = _side(left, "l", key).withColumn("l_there", F.lit(True)), _side(right, "r", key).withColumn("r_there", F.lit(True))
    once = lambda d: F.count("*").over(W.partitionBy(key)) == 1
    a, b = a.withColumn("l_once", once(a)), b.withColumn("r_once", once(b))
    a = a.withColumn("m", F.when(F.col("l_once"), F.col(key))).withColumnRenamed(key, "l_key")
    b = b.withColumn("m", F.when(F.col("r_once"), F.col(key))).withColumnRenamed(key, "r_key")
    kind = F.when(F.col("l_there").isNull(), "ADDED").when(F.col("r_there").isNull(), "REMOVED").otherwise("MODIFIED")
    return a.join(b, "m", "full").select(
        F.coalesce("l_key", "r_key").alias(key), kind.alias("change_type"),
        *[c for c in a.columns if c.startswith("l_") and c not in ("l_there", "l_once", "l_key")],
        *[c for c in b.columns if c.startswith("r_") and c not in ("r_there", "r_once", "r_key")],
    )


def signals(pairs: DataFrame, meanings: bool = True, department: str = "") -> DataFrame:
    """The severity context of pairs with l_text, r_text, l_section, r_section.

    ``meanings``: whether the meaning of a change comes from whole clause meanings
    or, cheaper, from requirement verbs and token overlap alone."""
    both = F.col("change_type") == "MODIFIED"
    left, right = T.blank(F.col("l_text")), T.blank(F.col("r_text"))
    pairs = pairs.withColumns({"_lc": T.policy_text(left), "_rc": T.policy_text(right)})
    overlap = T.jaccard(T.tokens(F.col("_lc"), cleaned=True), T.tokens(F.col("_rc"), cleaned=True))
    pairs = pairs.withColumns(
        {
            "distance": F.when(both, F.round(1.0 - overlap, 6)),
            "l_verb": S.requirement_verb(left),
            "r_verb": S.requirement_verb(right),
            "numeric": F.when(both, S.numeric_changes(left, right)).otherwise(F.array().cast("array<struct<type:string,old:string,new:string>>")),
            "cosmetic": both & S.is_cosmetic(left, right),
            "formatting_only": both & S.is_formatting_only(left, right),
            "reference_only": both & S.is_reference_only(left, right),
            "entity_type": S.entity_type(F.concat_ws(" ", left, right)),
            "procedure_change": both & S.is_procedure_change(left, right),
            "setup_change": both & S.is_setup_change(left, right),
            "alignment_type": F.when(both & (F.col("l_section") != F.col("r_section")), "moved").otherwise("same"),
            "department": F.lit(department),
        }
    )
    direction = S.verb_direction(F.col("l_verb"), F.col("r_verb"))
    pairs = pairs.withColumns({"verb_direction": F.when(both, direction), "n_numeric": F.size("numeric")})
    if meanings:
        pairs = pairs.withColumns({"_lm": S.clause_meaning(F.col("_lc")), "_rm": S.clause_meaning(F.col("_rc"))})
        shift = S.obligation_change(F.col("_lm.obligation"), F.col("_rm.obligation"))
        score = S.meaning_score(F.col("_lm"), F.col("_rm"))
    else:
        shift = F.coalesce(F.col("verb_direction"), F.lit("unchanged"))
        score = 1.0 - F.col("distance")
    changed = (
        F.when(~both | F.col("formatting_only"), "unchanged")
        .when(shift != "unchanged", shift)
        .when((score < REVIEWED) & ~F.col("cosmetic"), "changed")
        .otherwise("unchanged")
    )
    return severity.with_context(pairs.withColumn("meaning_change", changed))


def is_change(pairs_context: bool = True) -> Column:
    """Whether a pair with its signals is worth a record."""
    still = F.col("meaning_change") == "unchanged"
    same = T.pure_hash(F.col("l_text")) == T.pure_hash(F.col("r_text"))
    settled = (F.col("alignment_type") != "moved") & still & (((F.col("distance") <= SAME) & ~F.col("cosmetic")) | same)
    trivial = T.is_trivial(F.col("l_text")) & T.is_trivial(F.col("r_text"))
    return ~trivial & ((F.col("change_type") != "MODIFIED") | ~settled)


def where_once(rows: DataFrame, test: Column) -> DataFrame:
    """``rows`` that pass, each column computed once a row.  A filter moves below the
    columns that it reads, which then are computed in it again, and again for each other
    column they make; it stays above a column that is not deterministic."""
    return rows.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) & test).drop("_row")


def change_records(left: DataFrame, right: DataFrame, meanings: bool = True, department: str = "") -> DataFrame:
    """One row a change: what it is, how severe and why."""
    found = where_once(signals(align(left, right), meanings, department), is_change())
    found = found.withColumn("verdict", severity.classify())
    return found.select(
        "node", "change_type", "alignment_type", F.coalesce("l_section", "r_section").alias("section"), "l_text", "r_text",
        "distance", "meaning_change", "verb_direction", "n_numeric", "numeric", "cosmetic", "formatting_only", "reference_only", "entity_type",
        "verdict", F.when(F.col("change_type") == "MODIFIED", F.round(1.0 - F.col("distance"), 4)).otherwise(1.0).alias("confidence"),
        F.concat_ws(":", "change_type", F.when(F.col("change_type") != "ADDED", F.col("node")), F.when(F.col("change_type") != "REMOVED", F.col("node"))).alias("change_id"),
    )


def severity_order(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "low", 2).otherwise(1)
