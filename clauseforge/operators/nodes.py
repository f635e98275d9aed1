"""Nodes of documents before they are compared: which count, where pages split
them, what their sections exclude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import semantics as S
from clauseforge.functions import text as T
from clauseforge.operators import sequences

COMPARED = ("clause", "table", "paragraph", "list_item", "definition", "note", "warning")


def page_continuation(w) -> Column:
    """Whether a node goes on where the one before it (in window w) ends: of its type and
    section and, a table, of as many columns but one and without a header in its first
    row, or, a text, an unfinished sentence or a list.  Pages are compared elsewhere."""
    before = lambda n: F.lag(n).over(w)
    columns = (before("n_cols") <= 0) | (F.col("n_cols") <= 0) | (F.abs(before("n_cols") - F.col("n_cols")) <= 1)
    table = F.coalesce(columns, F.lit(True)) & ~F.coalesce("has_header", F.lit(False))
    said = (F.trim(T.blank(before("text"))) != "") & (F.trim(T.blank(F.col("text"))) != "")
    listed = F.coalesce(before("is_list"), F.lit(False)) | F.coalesce("is_list", F.lit(False))
    text = said & (listed | (~T.ends_sentence(before("text")) & T.starts_lower(F.col("text"))))
    same = (before("node_type") == F.col("node_type")) & (before("section") == F.col("section"))
    return F.coalesce(same & F.when(F.col("node_type") == "table", table).when(F.col("node_type").isin("clause", "paragraph"), text).otherwise(False), F.lit(False))


def stitched(nodes: DataFrame) -> DataFrame:
    """``(doc, section, node_type, page, ord, text, n)``: ``nodes(doc, section, page, ord,
    node_type, text, n_cols, has_header, is_list)`` that a page break has split, joined.

    A run keeps the page of its first node and takes in nodes of the next page only.
    Whether a node continues a run hangs on whether the one before it does, which flips
    with each page turned since the last break: so the parity of a running count
    decides, and no state is carried from row to row."""
    w = W.partitionBy("doc").orderBy("section", "page", "ord")
    turn = F.col("page") - F.lag("page").over(w)
    n = nodes.withColumns({"_goes_on": page_continuation(w) & turn.isin(0, 1), "_turn": turn})
    n = n.withColumn("_break", F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(w))
    flips = F.sum(F.when(F.col("_goes_on") & (F.col("_turn") == 1), 1).otherwise(0)).over(W.partitionBy("doc", "_break").orderBy("section", "page", "ord"))
    n = n.withColumn("_begins", F.when(flips % 2 == 1, 0).otherwise(1))
    n = n.withColumn("_run", F.sum("_begins").over(w))
    told = F.array_sort(F.collect_list(F.when(F.trim(T.blank(F.col("text"))) != "", F.struct("page", "ord", F.trim("text").alias("t")))))
    first = lambda c: F.min_by(c, F.struct("page", "ord")).alias(c)
    joined = F.array_join(F.transform(told, lambda x: x["t"]), "\n\n").alias("text")
    return n.groupBy("doc", "_run").agg(first("section"), first("node_type"), F.min("page").alias("page"), first("ord"), joined, F.count("*").alias("n")).drop("_run")


def content_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes to compare of each ``doc``: those of a compared type that say something,
    without low priorities if others are left; a document with none keeps all."""
    kept = F.col("node_type").isin(*COMPARED) & ~T.is_trivial(F.col("text"))
    low = F.coalesce("low_priority", F.lit(False))
    rank = F.when(kept & ~low, 2).when(kept, 1).otherwise(0)
    n = nodes.withColumn("_rank", rank)
    return n.withColumn("_best", F.max("_rank").over(W.partitionBy("doc"))).where("_rank = _best").drop("_rank", "_best")


def is_indexable(kind: Column, c: Column, exclusion: Column) -> Column:
    return kind.isin("clause", "table") & (T.collapse(c) != "") & exclusion.isNull()


def prepared(chunks: DataFrame) -> DataFrame:
    """Chunks without auxiliary, noisy and trivial ones, broken sentences joined."""
    said = F.col("kind").isin("clause", "table")
    odd = S.is_auxiliary(F.col("text"), F.col("section")) | (said & (T.is_noise(F.col("text")) | T.is_trivial(F.col("text"))))
    return sequences.merge_sentences(chunks.where(~odd))


def inherited_exclusions(nodes: DataFrame, exclusions: DataFrame) -> DataFrame:
    """``(doc, node, reason)``: the reason of the shallowest excluded section around each
    node; ``nodes(doc, node, path)``, ``exclusions(doc, path, reason)`` with paths as
    arrays, one reason a path."""
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k)))
    around = nodes.where(F.size("path") > 0).select("doc", "node", prefixes.alias("path"))
    return around.join(exclusions, ["doc", "path"]).groupBy("doc", "node").agg(F.min_by("reason", F.size("path")).alias("reason"))


def page_ranges(tables: DataFrame, density: float = 0.3, margin: int = 1) -> DataFrame:
    """``(doc, first, last)``: the pages around tables of few filled cells, ranges that
    touch united; ``tables(doc, page, density, pages)``."""
    low = F.greatest(F.lit(1), F.col("page") - margin)
    high = F.least(F.col("pages"), F.col("page") + margin)
    r = tables.where(F.col("density") < density).select("doc", low.alias("low"), high.alias("high")).distinct()
    w = W.partitionBy("doc").orderBy("low", "high")
    apart = F.coalesce(F.col("low") > F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True))
    island = r.withColumn("_apart", apart.cast("int")).withColumn("_island", F.sum("_apart").over(w))
    return island.groupBy("doc", "_island").agg(F.min("low").alias("first"), F.max("high").alias("last")).drop("_island")


def blocks(c: Column, most: int = 1200, packed: int = 900) -> Column:
    """A scanned page's text as blocks: paragraphs, those over ``most`` characters as
    sentences packed up to ``packed``."""
    empty = F.array().cast("array<string>")

    def pack(done: Column, s: Column) -> Column:
        longer = F.when(done["open"] == "", s).otherwise(F.concat(done["open"], F.lit(" "), s))
        full = (done["open"] != "") & (F.length(longer) > packed)
        return F.struct(F.when(full, F.array_append(done["out"], done["open"])).otherwise(done["out"]).alias("out"), F.when(full, s).otherwise(longer).alias("open"))

    def sentences(p: Column) -> Column:
        parts = F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda s: s != "")
        start = F.struct(empty.alias("out"), F.lit("").alias("open"))
        return F.aggregate(parts, start, pack, lambda d: F.when(d["open"] == "", d["out"]).otherwise(F.array_append(d["out"], d["open"])))

    paragraphs = F.filter(F.transform(F.split(T.blank(c), r"\n\s*\n+"), T.collapse), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(sentences(p))))
