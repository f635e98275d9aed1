"""Mixing to target weights with soft membership; DataFrame functions only.

A naive Bayes classifier, counted from a labelled table, gives each document its
posteriors over domains.  Projected gradient steps then fit nonnegative document
rates so that the expected tokens of each domain, sum(rate * tokens * posterior),
match the targets in least squares.  A step needs only the residual of each
domain, so the driver holds one number a domain and the documents stay where they
are."""

from __future__ import annotations

import logging
from math import log
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.labelled import sample_rows
from clauseforge.llm.storage import materialize

WORDS, ENDINGS = 1 << 16, 1 << 12  # buckets for hashed words and for their last two characters
TRAIN_ROWS = 4_000  # labelled rows to count from, at most
SHRINK = 20.0  # pseudo-counts that draw a rare bucket's evidence to none
SHARPNESS = 300.0  # words' worth of evidence that a document's mean counts as, at most
STEPS, TOLERANCE, CUT = 60, 1e-4, 12
MISS = 0.01
LOG = logging.getLogger(__name__)


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, word)``, lower-case; a text without a word has one row with ''."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.explode(F.split(F.trim(text), r"[\x20\x09-\x0D]+")).alias("word")
    )


def _word_bucket() -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(WORDS)).cast("int")


def _ending_bucket() -> Column:
    return F.pmod(F.xxhash64(F.right("word", F.lit(2))), F.lit(ENDINGS)).cast("int") + WORDS


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS):
    """``(weights, priors)`` from at most ``rows`` of ``labelled(doc_id, domain)``:
    weights is a DataFrame (k, w0, w1, ...) of WORDS + ENDINGS rows at most, the
    log of a bucket's count in a domain over what the domain's size would give,
    both with SHRINK added.  Labels outside ``domains``, and null ones, are passed
    over."""
    picked = sample_rows(
        labelled.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("t_id"), "domain"), "t_id", rows
    )
    found = {r["domain"]: r["n"] for r in picked.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    priors = [(found.get(d, 0) + 1.0) / (sum(found.values()) + len(domains)) for d in domains]
    d = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    texts = d.join(F.broadcast(picked), d["doc_id"] == picked["t_id"])
    words = texts.select("domain", F.explode(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counts = (
        words.select("domain", F.explode(F.array(_word_bucket(), _ending_bucket())).alias("k"))
        .groupBy("k")
        .agg(*[F.count_if(F.col("domain") == d).cast("double").alias(f"c{i}") for i, d in enumerate(domains)])
    )
    total = counts.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(len(domains))]).first()
    size = [total[f"t{i}"] for i in range(len(domains))]
    both = sum((F.col(f"c{i}") for i in range(1, len(domains))), F.col("c0"))
    logs = [F.log((F.col(f"c{i}") + SHRINK) / (both * (size[i] / max(sum(size), 1.0)) + SHRINK)) for i in range(len(domains))]
    return materialize(counts.select("k", *[w.alias(f"w{i}") for i, w in enumerate(logs)]), "weights"), priors


def posteriors(
    docs: DataFrame, weights: DataFrame, priors: list[float], id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS
) -> DataFrame:
    """``(doc_id, n_tokens, p0, p1, ...)``, a row for each id.  The words meet a
    broadcast table of WORDS + ENDINGS rows at most and are summed by document before
    the shuffle."""
    n = len(priors)
    first = F.broadcast(weights.select(F.col("k").alias("k1"), *[F.col(f"w{i}").alias(f"a{i}") for i in range(n)]))
    second = F.broadcast(weights.select(F.col("k").alias("k2"), *[F.col(f"w{i}").alias(f"b{i}") for i in range(n)]))
    words = _words(docs, id_col, text_col).withColumn("x1", _word_bucket()).withColumn("x2", _ending_bucket())
    met = words.join(first, F.col("x1") == F.col("k1"), "left").join(second, F.col("x2") == F.col("k2"), "left")
    there = F.col("word") != ""
    sums = met.groupBy("doc_id").agg(
        F.count_if(there).alias("n_tokens"),
        *[F.sum(F.when(there, F.coalesce(f"a{i}", F.lit(0.0)) + F.coalesce(f"b{i}", F.lit(0.0))).otherwise(0.0)).alias(f"s{i}") for i in range(n)],
    )
    z = [F.lit(log(priors[i])) + F.col(f"s{i}") / F.greatest("n_tokens", F.lit(1)) * F.least(F.lit(sharpness), F.col("n_tokens").cast("double")) for i in range(n)]
    scored = sums.select("doc_id", "n_tokens", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    top = F.greatest(*[f"z{i}" for i in range(n)]) if n > 1 else F.col("z0")
    grown = scored.select("doc_id", "n_tokens", *[F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in range(n)])
    whole = sum((F.col(f"e{i}") for i in range(1, n)), F.col("e0"))
    return grown.select("doc_id", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(n)])


def _largest_eigenvalue(m: list[list[float]]) -> float:
    v, size = [1.0] * len(m), 0.0
    for _ in range(100):
        v = [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]
        size = max(map(abs, v), default=0.0)
        if size == 0:
            return 0.0
        v = [x / size for x in v]
    return size


def fit_rates(members: DataFrame, n: int, targets: list[float], total_tokens: float | None = None, keep_domain: int | Literal["fullest"] | None = None, lowest: float = 0.0) -> tuple[DataFrame, list[float]]:
    """``members(doc_id, n_tokens, p0, ...)`` -> the same with ``rate``, and the
    relative residual of each domain.

    The targets are weights that are scaled to sum 1, times ``total_tokens``: by
    default the tokens there are, or with ``keep_domain`` as many as leave that
    domain's tokens unchanged ("fullest": the one with the most tokens for its target,
    so that no other has to be lowered).  Least squares weigh each domain's residual by the
    inverse of its natural share, and steps start from rate 1, so that without a
    need to change nothing does; rates are projected to ``lowest`` or more.  Each step is one aggregation; the rates are an
    expression of the residuals so far and are written out every CUT steps."""
    tokens = F.col("n_tokens").cast("double")
    now = materialize(members, "members").withColumn("rate", F.lit(1.0))
    p = [F.col(f"p{i}") for i in range(n)]
    first = now.agg(
        F.coalesce(F.sum(tokens), F.lit(0.0)).alias("all"),
        *[F.coalesce(F.sum(tokens * p[i]), F.lit(0.0)).alias(f"m{i}") for i in range(n)],
        *[F.coalesce(F.sum(tokens * p[i] * p[j]), F.lit(0.0)).alias(f"q{i}_{j}") for i in range(n) for j in range(n)],
    ).first()
    whole = first["all"]
    scale = sum(targets)
    if whole <= 0 or scale <= 0:
        return now, [0.0] * n
    share = [w / scale for w in targets]
    if keep_domain == "fullest":
        keep_domain = max((i for i in range(n) if share[i] > 0), key=lambda i: first[f"m{i}"] / share[i])
    if total_tokens is None:
        total_tokens = whole if keep_domain is None else first[f"m{keep_domain}"] / max(share[keep_domain], 1e-9)
    wanted = [s * total_tokens / whole for s in share]
    weight = [1.0 / max(first[f"m{i}"] / whole, 1e-6) for i in range(n)]
    curve = [[(weight[i] * weight[j]) ** 0.5 * first[f"q{i}_{j}"] / whole for j in range(n)] for i in range(n)]
    step = 1.0 / max(_largest_eigenvalue(curve), 1e-9)
    got = [first[f"m{i}"] / whole for i in range(n)]
    for k in range(1, STEPS + 1):
        if max(abs(got[i] - wanted[i]) for i in range(n)) <= TOLERANCE:
            break
        move = sum((p[i] * (step * weight[i] * (got[i] - wanted[i])) for i in range(1, n)), p[0] * (step * weight[0] * (got[0] - wanted[0])))
        now = now.withColumn("rate", F.greatest(F.lit(lowest), F.col("rate") - move))
        if k % CUT == 0:
            now = materialize(now, "rates")
        sums = now.agg(*[F.sum(tokens * F.col("rate") * p[i]).alias(f"g{i}") for i in range(n)]).first()
        got = [sums[f"g{i}"] / whole for i in range(n)]
    return materialize(now, "rates"), [got[i] - wanted[i] for i in range(n)]


def copies(rate: Column, doc_id: Column, rounding: Literal["random", "nearest"] = "random") -> Column:
    """Whole copies of a document: its rate rounded by a hash of the id, which
    keeps expected totals, or to the nearest number."""
    if rounding == "nearest":
        return F.round(rate).cast("int")
    draw = F.pmod(F.xxhash64(doc_id, F.lit(101)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    total_tokens: float | None = None,
    keep_domain: str | None = None,
    lowest: float = 0.0,
    rounding: Literal["random", "nearest"] = "random",
    raise_only: bool = False,
) -> DataFrame:
    """``(doc_id, n_tokens, p_<domain>..., rate, copies)``, one row for each id of
    ``docs``, given ``labelled(doc_id, domain)`` and target weights by domain.
    ``raise_only``: no rate is below 1, and the fullest domain keeps its tokens.  What
    targets are missed by, as shares of all tokens, is logged, from MISS on as a warning.

    Null and empty texts have no tokens and the labelled shares as posteriors.
    Rows that repeat an id are one document with all their text; null ids take no
    part.  Without labels the posteriors are even.  An empty table gives no rows;
    further columns are ignored."""
    domains = sorted(targets)
    weights, priors = train(docs, labelled, domains, id_col, text_col)
    members = posteriors(docs, weights, priors, id_col, text_col)
    keep = "fullest" if raise_only else None if keep_domain is None else domains.index(keep_domain)
    fitted, missed = fit_rates(members, len(domains), [targets[d] for d in domains], total_tokens, keep, 1.0 if raise_only else lowest)
    worst = max(map(abs, missed), default=0.0)
    LOG.log(logging.WARNING if worst >= MISS else logging.INFO, "mixing misses its targets by %s", {d: round(m, 4) for d, m in zip(domains, missed, strict=True)})
    return fitted.select(
        "doc_id", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
        copies(F.col("rate"), F.col("doc_id"), rounding).alias("copies"),
    )


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their columns, as often as ``mixed(doc_id, copies)``
    says, but once at least; rows without an id, or with one that it lacks, once."""
    free = "_" * (1 + max((len(c) - len(c.rstrip("_")) for c in docs.columns), default=0))
    told = mixed.select(F.col("doc_id").alias(f"mixed_id{free}"), F.col("copies").alias(f"copies{free}"))
    named = docs.where(F.col(id_col).isNotNull()).join(told.hint("merge"), docs[id_col] == told[f"mixed_id{free}"], "left")
    times = F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce(f"copies{free}", F.lit(1)), F.lit(1))))
    # null ids stay out of the join, where they would meet in one task
    return named.select(*docs.columns, times.alias(f"copy{free}")).select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
