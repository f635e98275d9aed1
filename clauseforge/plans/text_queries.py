"""Queries of text functions, over lines of documents and policy clauses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import lexicon as L
from clauseforge.functions import semantics as S
from clauseforge.functions import text as T
from clauseforge.plans import fixtures as X
from clauseforge.plans.catalog import query

LINES = "SELECT doc_id, CAST(i - 1 AS INT) AS ord, list_extract(parts, i) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"
C1, C2 = X.plain(X.CLAUSES_V1), X.plain(X.CLAUSES_V2)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, line) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(x: str, steps: list[tuple[str, str]], flags: str = "(?i)") -> str:
    return reduce(lambda a, st: f"regexp_replace({a}, {q(flags + st[0])}, {q(st[1])}, 'g')", steps, x)


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g'))"


def verb_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), {q(p)}) THEN {q(v)}" for p, v in L.VERBS) + " ELSE '' END"


def strength_sql(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.VERB_STRENGTH.items()) + " END"


def numbers_sql(x: str) -> str:
    found = f"regexp_extract_all({x}, {q('(?i)' + L.NUMBER)})"
    return f"list_sort(list_distinct(list_transform({found}, lambda n: regexp_replace(lower(trim(n)), '\\s+', ' ', 'g'))))"


@query("text_normalize", f"SELECT doc_id, ord, lower({collapsed('line')}) AS norm, trim(regexp_replace(lower({collapsed('line')}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM ({LINES})")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ord", T.normalize(F.col("line")).alias("norm"), T.slug(F.col("line")).alias("slug"))


@query("text_comparison_norm")
def text_comparison_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ord", T.comparable(F.col("line")).alias("norm"))


_KEPT = "regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]', '', 'g')"


@query("text_pure_hash_dupes", f"SELECT h, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN {_KEPT} = '' THEN '' ELSE sha256({_KEPT}) END AS h FROM documents) GROUP BY h HAVING count(*) > 1")
def text_pure_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.pure_hash(F.col("text")).alias("h"))
    return docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower({collapsed('line')}), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains([{', '.join(q(w) for w in T.stopwords('en'))}], t)))"


@query(
    "text_tokens_jaccard_neighbors",
    f"WITH t AS (SELECT doc_id, ord, line, {_WORDS} AS w FROM ({LINES})), p AS (SELECT doc_id, ord, w, lag(w) OVER (PARTITION BY doc_id ORDER BY ord) AS v, ord > 0 AS later FROM t) "
    "SELECT doc_id, ord, round(CASE WHEN len(w) = 0 AND len(v) = 0 THEN 1.0 ELSE len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) END, 6) AS overlap FROM p WHERE later",
)
def text_tokens_jaccard_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of each line with the one before it."""
    w = W.partitionBy("doc_id").orderBy("ord")
    t = lines(spark, sf_dir).select("doc_id", "ord", F.array_distinct(T.tokens(T.normalize(F.col("line")), "en", cleaned=True)).alias("w"))
    p = t.withColumn("v", F.lag("w").over(w)).where("ord > 0")
    return p.select("doc_id", "ord", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("overlap"))


_L = collapsed("line")


@query(
    "noise_predicates",
    f"SELECT doc_id, ord, len({_L}) < 5 OR regexp_full_match({_L}, '[^\\p{{L}}]+') AS noise, len({_L}) <= 7 OR regexp_full_match({_L}, '[\\d\\s.\\-/,;:()\\[\\]]+') "
    f"OR (len({_L}) <= 20 AND len(regexp_replace({_L}, '[^0-9]', '', 'g')) / greatest(len({_L}), 1) > 0.65) AS trivial, "
    f"regexp_matches(rtrim(line), '[.!?:;]$') AS ended, regexp_matches(line, '^[^\\p{{L}}]*\\p{{Ll}}') AS lower_start FROM ({LINES})",
)
def noise_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "ord", T.is_noise(c).alias("noise"), T.is_trivial(c).alias("trivial"), T.ends_sentence(c).alias("ended"), T.starts_lower(c).alias("lower_start"))


_CAPITALS = "^[^\\p{L}]*(\\p{Lu}\\p{Ll}*[^\\p{L}]+)*(\\p{Lu}\\p{Ll}*)[^\\p{L}]*$"
_ODD = f"(length(t) < 25 OR regexp_matches(t, {q('(?i)' + L.FIGURE_CAPTION)}) OR (length(t) <= 45 AND (t = upper(t) OR regexp_matches(t, {q(_CAPITALS)}))) OR (length(t) < 30 AND regexp_matches(t, '^\\p{{Ll}}')))"


@query("orphan_fragments", f"SELECT doc_id, ord, t <> '' AND NOT regexp_matches(t, {q('(?i)' + L.ORPHAN_OBLIGATION)}) AND {_ODD} AS orphan FROM (SELECT doc_id, ord, {collapsed('line')} AS t FROM ({LINES}))")
def orphan_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "ord", T.is_orphan(F.col("line"), F.lit("clause")).alias("orphan"))


@query("pii_mask", "SELECT doc_id, " + replaced("text", list(L.PII)) + " AS masked FROM documents")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.mask_pii(F.col("text")).alias("masked"))


_LEXICON = {"en": ("the", "and", "of", "to", "is"), "de": ("der", "die", "und", "das", "den"), "fr": ("le", "la", "les", "et", "de"), "es": ("el", "los", "que", "del", "las")}
_HITS = {k: f"len(list_filter(string_split(lower(text), ' '), lambda w: list_contains([{', '.join(map(q, v))}], w)))" for k, v in _LEXICON.items()}


@query(
    "language_lexicon",
    "SELECT doc_id, CASE " + " ".join(f"WHEN {k} > greatest({', '.join(x for x in _LEXICON if x != k)}) THEN '{k}'" for k in _LEXICON)
    + " ELSE '' END AS language FROM (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _HITS.items()) + " FROM documents)",
)
def language_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language whose frequent words a text has most of; '' for none or a tie."""
    words = F.split(F.lower("text"), " ")
    among = lambda v: F.size(F.filter(words, lambda w: w.isin(*v)))
    hits = {k: among(v) for k, v in _LEXICON.items()}
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *[h.alias(k) for k, h in hits.items()])
    cases = [(F.col(k) > F.greatest(*[x for x in hits if x != k]), k) for k in hits]
    return d.select("doc_id", S.ladder(cases).alias("language"))


@query(
    "header_footer_filter",
    f"WITH l AS (SELECT doc_id, ord, ord // 10 + 1 AS page, trim(line) AS t FROM ({LINES})), n AS (SELECT doc_id, t, count(DISTINCT page) AS pages FROM l WHERE len(t) BETWEEN 1 AND 120 GROUP BY ALL), "
    "d AS (SELECT doc_id, count(DISTINCT page) AS whole FROM l GROUP BY ALL) SELECT l.doc_id, l.ord FROM l JOIN d USING (doc_id) LEFT JOIN n ON n.doc_id = l.doc_id AND n.t = l.t "
    f"WHERE NOT (len(l.t) BETWEEN 1 AND 200 AND (regexp_matches(l.t, {q('(?i)' + L.PAGE_NUMBER)}) OR " + " OR ".join(f"contains(lower(l.t), {q(x)})" for x in L.CONFIDENTIALITY)
    + ")) AND NOT coalesce(n.pages >= greatest(2, CAST(floor(0.4 * d.whole) AS BIGINT)), false)",
)
def header_footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no page header or footer: neither by pattern nor by standing
    on many pages of their document."""
    t = lines(spark, sf_dir).select("doc_id", "ord", (F.floor(F.col("ord") / 10) + 1).alias("page"), F.trim("line").alias("t"))
    often = t.where(F.length("t").between(1, 120)).groupBy("doc_id", "t").agg(F.countDistinct("page").alias("pages"))
    whole = t.groupBy("doc_id").agg(F.countDistinct("page").alias("whole"))
    bad = often.join(whole, "doc_id").where(F.col("pages") >= F.greatest(F.lit(2), F.floor(0.4 * F.col("whole")))).select("doc_id", "t")
    return t.where(~T.is_header_footer(F.col("t"))).join(bad, ["doc_id", "t"], "left_anti").select("doc_id", "ord")


_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains([{', '.join(q(w) for w in T.stopwords())}], t))"


@query("policy_tokens", f"SELECT node, array_to_string({_TOKENS}, ' ') AS tokens FROM ({C1})")
def policy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sql(spark, sf_dir, X.CLAUSES_V1).select("node", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("requirement_verbs", f"SELECT node, {verb_sql('text')} AS verb FROM ({C1})")
def requirement_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sql(spark, sf_dir, X.CLAUSES_V1).select("node", S.requirement_verb(F.col("text")).alias("verb"))


PAIRS = f"SELECT a.node, a.section AS ls, b.section AS rs, a.text AS lt, b.text AS rt FROM ({C1}) a JOIN ({C2}) b ON a.node = b.node"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.sql(spark, sf_dir, X.CLAUSES_V1).select("node", F.col("section").alias("ls"), F.col("text").alias("lt"))
    b = X.sql(spark, sf_dir, X.CLAUSES_V2).select("node", F.col("section").alias("rs"), F.col("text").alias("rt"))
    return a.join(b, "node")


@query(
    "requirement_verb_change",
    f"SELECT node, lv AS old, rv AS new, CASE WHEN {strength_sql('rv')} > {strength_sql('lv')} THEN 'strengthened' WHEN {strength_sql('rv')} < {strength_sql('lv')} THEN 'weakened' ELSE 'changed' END AS direction "
    f"FROM (SELECT node, {verb_sql('lt')} AS lv, {verb_sql('rt')} AS rv FROM ({PAIRS})) WHERE lv <> rv",
)
def requirement_verb_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("node", S.requirement_verb(F.col("lt")).alias("old"), S.requirement_verb(F.col("rt")).alias("new"))
    return p.withColumn("direction", S.verb_direction(F.col("old"), F.col("new"))).where("direction is not null")


NUMERIC_SQL = (
    "array_to_string(list_transform(range(1, greatest(len(gone), len(come)) + 1), lambda i: CASE WHEN i > len(come) THEN 'removed' WHEN i > len(gone) THEN 'added' ELSE 'modified' END "
    "|| ':' || coalesce(list_extract(gone, i), '') || '>' || coalesce(list_extract(come, i), '')), '; ')"
)


def _numeric_pairs(source: str) -> str:
    return (
        f"SELECT *, list_sort(list_filter(ln, lambda x: NOT list_contains(rn, x))) AS gone, list_sort(list_filter(rn, lambda x: NOT list_contains(ln, x))) AS come "
        f"FROM (SELECT *, {numbers_sql('lt')} AS ln, {numbers_sql('rt')} AS rn FROM ({source}))"
    )


@query("numeric_changes", f"SELECT node, {NUMERIC_SQL} AS changes FROM ({_numeric_pairs(PAIRS)}) WHERE len(gone) + len(come) > 0")
def numeric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("node", S.numeric_changes(F.col("lt"), F.col("rt")).alias("c")).where(F.size("c") > 0)
    show = lambda x: F.concat(x["type"], F.lit(":"), T.blank(x["old"]), F.lit(">"), T.blank(x["new"]))
    return p.select("node", F.array_join(F.transform("c", show), "; ").alias("changes"))


@query("clause_meaning")
def clause_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sql(spark, sf_dir, X.CLAUSES_V1).select("node", S.clause_meaning(T.policy_text(F.col("text"))).alias("m")).select("node", "m.*", S.signature(F.col("m")).alias("signature"))


@query("meaning_compare")
def meaning_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda c: S.clause_meaning(T.policy_text(F.col(c)))
    p = pairs(spark, sf_dir).select("node", m("lt").alias("a"), m("rt").alias("b"))
    return p.select("node", F.round(S.meaning_score(F.col("a"), F.col("b")), 6).alias("score"), S.obligation_change(F.col("a.obligation"), F.col("b.obligation")).alias("obligation_change"))


def _plain(x: str) -> str:
    return f"lower({collapsed('regexp_replace(' + x + ', ' + q('[-–—' + chr(10) + chr(13) + ';]') + ', ' + q(' ') + ', ' + q('g') + ')')})"


def _alnum(x: str, gap: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '{gap}', 'g'))"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, {q('(?i)' + L.REFERENCE)}, '', 'g')"


FLAGS_SQL = (
    f"lt <> rt AND {_plain('lt')} = {_plain('rt')} AS formatting_only, "
    f"{numbers_sql('lt')} <> {numbers_sql('rt')} AND {numbers_sql(_bare('lt'))} = {numbers_sql(_bare('rt'))} AS reference_only, "
    f"lt <> rt AND ({_alnum('lt', ' ')} = {_alnum('rt', ' ')} OR ({_alnum('lt', '')} = {_alnum('rt', '')} AND regexp_extract_all(lt, '\\d+(?:[.,]\\d+)*') = regexp_extract_all(rt, '\\d+(?:[.,]\\d+)*'))) AS cosmetic"
)


@query("formatting_reference_cosmetic_flags", f"SELECT node, {FLAGS_SQL} FROM ({PAIRS})")
def formatting_reference_cosmetic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("lt"), F.col("rt")
    return pairs(spark, sf_dir).select(
        "node", S.is_formatting_only(a, b).alias("formatting_only"), S.is_reference_only(a, b).alias("reference_only"), S.is_cosmetic(a, b).alias("cosmetic")
    )


def _hint(p: str) -> str:
    return f"regexp_matches(trim(text), {q('(?i)' + p)})"


_SCORE = f"round(least(0.1 + CASE WHEN {_hint(L.OBLIGATION_HINT)} OR {_hint(L.OBLIGATIONS[3][1])} THEN 0.4 ELSE 0 END + CASE WHEN {_hint(L.DURATION_HINT)} OR {_hint(L.NUMBER_HINT)} THEN 0.15 ELSE 0 END + CASE WHEN {_hint(L.ROLE_HINT)} THEN 0.15 ELSE 0 END + CASE WHEN {_hint(L.REGULATION_HINT)} THEN 0.1 ELSE 0 END, 1.0), 6)"


@query(
    "importance_scores",
    f"SELECT node, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS level, {_hint(L.CAPTION_ONLY)} AND len(string_split(trim(text), ' ')) <= 12 AS caption FROM (SELECT node, text, {_SCORE} AS score FROM ({C2}))",
)
def importance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.sql(spark, sf_dir, X.CLAUSES_V2).select("node", S.importance(F.col("text"), F.lit("clause")).alias("i"), S.is_caption_like(F.col("text")).alias("caption"))
    return c.select("node", "i.*", "caption")


def entity_sql(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, {q('(?i)' + L.FIELD_STRENGTH)}) THEN 'FieldStrength' WHEN regexp_matches({x}, {q('(?i)' + L.EMISSION_LIMIT)}) THEN 'EmissionLimit' "
        f"WHEN regexp_matches({x}, {q('(?i)' + L.ACCEPTANCE_CLASS)}) THEN 'AcceptanceCriterion' WHEN regexp_matches({x}, {q('(?i)' + L.TEST_METHOD)}) THEN 'TestMethod' "
        f"WHEN regexp_matches({x}, {q('(?is)' + L.FREQUENCY_RANGE)}) THEN 'FrequencyRange' ELSE '' END"
    )


@query("entity_types", f"SELECT node, {entity_sql('text')} AS entity FROM ({C1})")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sql(spark, sf_dir, X.CLAUSES_V1).select("node", S.entity_type(F.col("text")).alias("entity"))


@query("stable_ids", "SELECT p_partkey AS k, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT p_partkey, sha1(unhex('" + T.UUID_URL_NAMESPACE + "') || encode('document::' || p_name)) AS h FROM part)")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("k"), T.uuid5_url(F.concat(F.lit("document::"), "p_name")).alias("id"))
