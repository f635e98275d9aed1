"""Change records after they are made: details, filters, groups, reports and events.
``records`` are rows of ``changes.change_records``, with ``pair`` for the compared
pair of documents where several are at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import labels
from clauseforge.functions import lexicon as L
from clauseforge.functions import text as T
from clauseforge.operators.changes import severity_order
from clauseforge.operators.metrics import percent

DETAIL = "array<struct<type:string,text:string,old:string,new:string,location:string>>"


def details(change: Column, alignment: Column, old: Column, new: Column, old_section: Column, new_section: Column) -> Column:
    """What a record says of its change: a text added, removed or modified; of moved
    nodes the sections first; of split and merged ones that they are."""
    one = lambda kind, text, a=None, b=None, at=None: F.struct(
        F.lit(kind).alias("type"), text.alias("text"), F.lit(a).alias("old"), F.lit(b).alias("new"), F.lit(at).cast("string").alias("location")
    )
    none = F.lit(None).cast("string")
    moved = (alignment == "moved") & (F.coalesce(old_section, F.lit("Unknown Section")) != F.coalesce(new_section, F.lit("Unknown Section")))
    turned = F.when(alignment == "split", "Node split into multiple nodes").otherwise("Multiple nodes merged into one node")
    move = one("modified", F.lit("Node moved between sections"), F.coalesce(old_section, F.lit("Unknown Section")), F.coalesce(new_section, F.lit("Unknown Section")), "section")
    text = one("modified", F.lit("Text changed"), old, new)
    said = (
        F.when(change == "ADDED", F.array(one("added", T.blank(new), none, none)))
        .when(change == "REMOVED", F.array(one("removed", T.blank(old), none, none)))
        .when(alignment.isin("split", "merged"), F.array(one("modified", turned, T.blank(old), T.blank(new), "structure")))
        .otherwise(F.array_compact(F.array(F.when(moved, move), F.when(~old.eqNullSafe(new), text))))
    )
    return said.cast(DETAIL)


def combined(nodes: DataFrame, group: str) -> DataFrame:
    """``(group, node_type, text, nodes)``: nodes joined in the order of page and ord;
    of several types it is a paragraph."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("ord", F.lit(0)).alias("ord"), "node", T.blank(F.col("text")).alias("t"))))
    texts = F.filter(F.transform(rows, lambda x: F.trim(x["t"])), lambda t: t != "")
    kind = F.when(F.countDistinct("node_type") == 1, F.min("node_type")).otherwise("paragraph")
    return nodes.groupBy(group).agg(kind.alias("node_type"), F.array_join(texts, "\n\n").alias("text"), F.array_join(F.transform(rows, lambda x: x["node"].cast("string")), ",").alias("nodes"))


def evidence(section: Column, page: Column, text: Column) -> Column:
    """Where a side of a record stands; null for a side that is not there."""
    return F.when(text.isNotNull(), F.struct(section.alias("section"), page.alias("page"), T.short(text, 200).alias("quote")))


def is_kept(records_section: Column, change: Column, structural: Column, old: Column, new: Column, same_section: Column) -> Column:
    """Whether a difference is worth showing: none of a reference section without a
    table number, and no equal texts in one section unless the structure changed."""
    path = F.array(T.blank(records_section))
    equal = (change == "MODIFIED") & same_section & (labels.markdown_text(old) == labels.markdown_text(new)) & (labels.markdown_text(old) != "")
    return ~labels.is_reference_section(path, F.lit(True)) & (structural | ~equal)


def unchanged_sections(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs(l_section, r_section)`` whose clauses and tables are the same texts,
    each as often; ``left`` and ``right`` are (section, text)."""

    def counted(d: DataFrame, side: str, sign: int) -> DataFrame:
        named = d.select(F.col("section").alias(f"{side}_section"), labels.markdown_text(F.col("text")).alias("said")).where("said <> ''")
        counts = named.groupBy(f"{side}_section", "said").agg((sign * F.count("*")).alias("n"))
        return pairs.join(counts, f"{side}_section").select("l_section", "r_section", "said", "n")

    both = counted(left, "l", 1).unionByName(counted(right, "r", -1)).groupBy("l_section", "r_section", "said").agg(F.sum("n").alias("n"))
    differing = both.where("n <> 0").select("l_section", "r_section")
    return pairs.join(differing, ["l_section", "r_section"], "left_anti")


def consolidated(tables: DataFrame, drop: float = 0.70, merge: float = 0.30) -> DataFrame:
    """``(section, decision, overlap, n_removed, n_added)`` of ``tables(section,
    change_type, text)``: removed and added tables of one section, or of one table
    number, are one table that a page split if their words overlap: 'dropped' from
    0.70, 'modified' from 0.30, else 'kept'."""
    t = tables.where(F.col("change_type").isin("REMOVED", "ADDED"))
    of = lambda kind: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("change_type") == kind, F.col("_words")))))
    count = lambda kind: F.count_if(F.col("change_type") == kind)
    words = F.filter(F.split(labels.markdown_text(F.col("text")), r"\s+"), lambda w: w != "")
    t = t.withColumn("_words", words)
    by_section = W.partitionBy("section")
    both = (F.max((F.col("change_type") == "REMOVED").cast("int")).over(by_section) == 1) & (F.max((F.col("change_type") == "ADDED").cast("int")).over(by_section) == 1)
    number = labels.caption_number(F.array("section"))
    t = t.withColumn("_key", F.when(both | number.isNull(), F.concat(F.lit("s:"), "section")).otherwise(F.concat(F.lit("n:"), number)))
    g = t.groupBy("_key").agg(F.min("section").alias("section"), of("REMOVED").alias("a"), of("ADDED").alias("b"), count("REMOVED").alias("n_removed"), count("ADDED").alias("n_added"))
    overlap = F.when((F.col("n_removed") > 0) & (F.col("n_added") > 0), F.round(T.jaccard(F.col("a"), F.col("b")), 6))
    decision = F.when(F.col("overlap") >= drop, "dropped").when(F.col("overlap") >= merge, "modified").otherwise("kept")
    return g.withColumn("overlap", overlap).select("section", decision.alias("decision"), "overlap", "n_removed", "n_added")


def chapters(records: DataFrame) -> DataFrame:
    """``(pair, chapter, n, unresolved, tokens, change_ids)``: records by the first part
    of their section; unresolved below a confidence of 0.5; four characters a token."""
    chapter = F.trim(F.element_at(F.split(F.coalesce("section", F.lit("Unknown Section")), "/"), 1))
    size = F.length(T.blank(F.col("l_text"))) + F.length(T.blank(F.col("r_text")))
    ids = F.array_join(F.array_sort(F.collect_list("change_id")), ",")
    return records.groupBy("pair", chapter.alias("chapter")).agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.5).alias("unresolved"), F.greatest(F.lit(1), F.floor(F.sum(size) / 4)).alias("tokens"), ids.alias("change_ids")
    )


def top(records: DataFrame, most: int) -> DataFrame:
    """The ``most`` most severe records of each pair, by node among equals."""
    w = W.partitionBy("pair").orderBy(severity_order(F.col("severity")), "node")
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def action_plan(records: DataFrame, most: int = 5) -> DataFrame:
    """``(pair, place, priority, action, timeline, owner)`` of the first highly severe records."""
    told = F.concat(F.lit("Assess compliance impact of "), F.lower("change_type"), F.lit(" items in "), F.col("section"))
    chosen = top(records.where("severity = 'high'"), most)
    return chosen.select("pair", "place", F.lit("High").alias("priority"), told.alias("action"), F.lit("60 days").alias("timeline"), F.lit("Compliance Team").alias("owner"))


def sample(records: DataFrame, most: int = 10, seed: int = 42) -> DataFrame:
    """``most`` records of each pair in the order of a seeded hash of their change_id."""
    w = W.partitionBy("pair").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "change_id"), 256), "change_id")
    return records.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def citation_coverage(records: DataFrame, *by: str) -> DataFrame:
    """How many records cite either side and both."""
    a, b = F.col("l_text").isNotNull(), F.col("r_text").isNotNull()
    ratio = F.when(F.count("*") == 0, 1.0).otherwise(F.round(F.count_if(a | b) / F.count("*"), 4))
    return records.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(a | b).alias("any_citation"), F.count_if(a & b).alias("both_citations"), ratio.alias("coverage"))


def extraction_score(chunks: DataFrame) -> DataFrame:
    """Counts of ``chunks(doc, kind, text, section)`` by kind and whole percentages."""
    size = F.length(F.trim(T.blank(F.col("text"))))
    whole = lambda n: F.floor(100 * n / F.count("*"))
    of = lambda *k: F.count_if(F.col("kind").isin(*k))
    return chunks.groupBy("doc").agg(
        F.count("*").alias("total"), of("clause").alias("clauses"), of("table").alias("tables"), of("heading").alias("headings"), of("figure").alias("figures"),
        F.coalesce(F.floor(F.avg(F.when(size > 0, size))), F.lit(0)).alias("avg_length"), whole(of("clause", "table")).alias("content_percent"),
        whole(F.count_if(T.blank(F.col("section")) != "")).alias("section_percent"),
    )


def audit(nodes: DataFrame) -> DataFrame:
    """Figures of ``nodes(doc, node_type, path, text, headers, page_from, page_to)`` for
    each document: sections of content nodes, tables, empty texts."""
    content, table = F.col("node_type").isin("paragraph", "list_item", "table"), F.col("node_type") == "table"
    depth = F.when(content & (F.size("path") > 0), F.size("path"))
    placeholder = table & F.exists(F.coalesce("headers", F.array().cast("array<string>")), lambda h: h.rlike(L.PLACEHOLDER_HEADER))
    return nodes.groupBy("doc").agg(
        F.count("*").alias("nodes"), F.count_if(content).alias("content_nodes"), F.round(100.0 * F.count(depth) / F.greatest(F.count_if(content), F.lit(1)), 1).alias("section_coverage"),
        F.round(F.coalesce(F.avg(depth), F.lit(0.0)), 2).alias("avg_depth"), F.coalesce(F.max(depth), F.lit(0)).alias("max_depth"),
        F.countDistinct(F.when(depth.isNotNull(), F.col("path"))).alias("sections"), F.count_if(table).alias("tables"), F.count_if(placeholder).alias("placeholder_tables"),
        percent(F.count_if(table) - F.count_if(placeholder), F.count_if(table)).alias("table_quality"),
        F.count_if(table & (F.col("page_from") != F.coalesce("page_to", "page_from"))).alias("cross_page_tables"), F.count_if(F.trim(T.blank(F.col("text"))) == "").alias("empty_nodes"),
    )


def extraction_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of ``(doc, node_type, stitched)`` before and after, and what they gained."""
    both = before.withColumn("_after", F.lit(0)).unionByName(after.withColumn("_after", F.lit(1)))
    n = lambda test, k: F.count_if(test & (F.col("_after") == k))
    table, joined = F.col("node_type") == "table", F.coalesce("stitched", F.lit(False))
    return both.groupBy("doc").agg(
        n(F.lit(True), 0).alias("nodes_before"), n(F.lit(True), 1).alias("nodes_after"), n(table, 0).alias("tables_before"), n(table, 1).alias("tables_after"),
        n(joined, 0).alias("stitched_before"), n(joined, 1).alias("stitched_after"), (n(table, 1) - n(table, 0)).alias("delta_tables"), (n(joined, 1) - n(joined, 0)).alias("delta_stitched"),
    )


def events(records: DataFrame) -> DataFrame:
    """``(pair, seq, type, change_id, row_markdown, skipped, requires_review)``: the
    records of a pair as the events of its report, the most severe first; ``said`` is
    what each row tells: SKIP or nothing skips it, HUMAN_REVIEW: marks it."""
    said = F.trim(T.blank(F.col("said")))
    review, skipped = F.upper(said).startswith("HUMAN_REVIEW:"), (said == "") | (F.upper(said) == "SKIP")
    w = W.partitionBy("pair").orderBy(severity_order(F.col("severity")), "node")
    text = F.when(review, F.trim(F.substring(said, len("HUMAN_REVIEW:") + 1, 1 << 30))).otherwise(said)
    line = F.when(~skipped, labels.table_line(F.coalesce("section", F.lit("—")), F.col("page"), F.col("change_type"), text, review))
    r = records.select("pair", "change_id", F.row_number().over(w).alias("place"), skipped.alias("skipped"), review.alias("requires_review"), line.alias("row_markdown"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("diff_start").alias("type")), F.struct(F.lit(1).alias("k"), F.lit("diff_complete").alias("type"))))
    done = F.col("e.k") == 1
    each = r.select("*", kinds.alias("e")).select(
        "pair", (2 * F.col("place") + F.col("e.k") - 1).alias("seq"), "e.type", "change_id", F.when(done, F.col("row_markdown")).alias("row_markdown"),
        F.when(done, F.col("skipped")).alias("skipped"), F.when(done, F.col("requires_review")).alias("requires_review"),
    )
    last = r.groupBy("pair").agg((2 * F.max("place") + 1).alias("seq")).select("pair", "seq", F.lit("done").alias("type"), *[F.lit(None).cast(t).alias(c) for c, t in (("change_id", "string"), ("row_markdown", "string"), ("skipped", "boolean"), ("requires_review", "boolean"))])
    return each.unionByName(last)


def compact(records: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` records of each pair, by severity and node, with
    ``old_section`` and ``new_section``: what those of their section say on each side."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "low", 2).otherwise(1)
    first = records.withColumn("_place", F.row_number().over(W.partitionBy("pair").orderBy(rank, "node"))).where(F.col("_place") <= most)
    said = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("node", F.col(side).alias("t"))))), lambda x: x["t"]), " ")
    told = first.groupBy("pair", "section").agg(said("l_text").alias("old_section"), said("r_text").alias("new_section"))
    return first.drop("_place").join(told, ["pair", "section"])


def key_differences(diffs: DataFrame, unchanged: DataFrame) -> DataFrame:
    """The ``diffs(change_type, section, l_section, r_section, l_text, r_text)`` that
    stay: none of a reference section without a table number, none of a pair of
    ``unchanged(l_section, r_section)`` and no equal texts.  A side without a section
    takes the partner of the other one, of several the least."""
    partner = lambda of, to: unchanged.groupBy(F.col(of).alias(f"_{of}")).agg(F.min(to).alias(f"_{to}_of"))
    reference = labels.is_reference_section(F.array(T.blank(F.coalesce("section", "l_section", "r_section"))), F.lit(True))
    old, new = labels.markdown_text(T.blank(F.col("l_text"))), labels.markdown_text(T.blank(F.col("r_text")))
    told = diffs.where(~reference & ~((F.col("change_type") == "MODIFIED") & (old == new) & (old != "")))
    met = told.join(partner("l_section", "r_section"), F.col("l_section") == F.col("_l_section"), "left").join(partner("r_section", "l_section"), F.col("r_section") == F.col("_r_section"), "left")
    sides = met.withColumns({"_l": F.coalesce("l_section", "_l_section_of"), "_r": F.coalesce("r_section", "_r_section_of")})
    still = unchanged.select(F.col("l_section").alias("_a"), F.col("r_section").alias("_b")).distinct()
    return sides.join(still, (F.col("_l") == F.col("_a")) & (F.col("_r") == F.col("_b")), "left_anti").select(*diffs.columns)


def folded(events: DataFrame) -> DataFrame:
    """``(pair, complete, n_diffs, n_skipped, requires_review, last_seq)``: each report
    as its ``events`` tell it; one without a done event is not complete."""
    done, diff = F.col("type") == "done", F.col("type") == "diff_complete"
    return events.groupBy("pair").agg(
        F.coalesce(F.bool_or(done), F.lit(False)).alias("complete"), F.count_if(diff).alias("n_diffs"), F.count_if(diff & F.col("skipped")).alias("n_skipped"),
        F.coalesce(F.bool_or(diff & ~F.col("skipped") & F.col("requires_review")), F.lit(False)).alias("requires_review"), F.max("seq").alias("last_seq"),
    )
