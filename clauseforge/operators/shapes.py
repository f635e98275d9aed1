"""Structure of tables: headers, captions, keys of rows, facts by row, and how two
versions differ.  Cells are rows ``(table_uid, row, col, text)``, rows and columns
from 0; spans are optional columns ``row_span`` and ``col_span``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.functions import labels, ontology
from clauseforge.functions import lexicon as L
from clauseforge.functions import semantics as S
from clauseforge.functions import text as T
from clauseforge.functions.semantics import ladder
from clauseforge.operators import matching

STRINGS = "array<string>"
CRITICAL = ("field_strength", "emission_limit", "acceptance_class", "frequency_range", "test_method")


def _span(cells: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(1)) if name in cells.columns else F.lit(1)


def _last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def headers(cells: DataFrame) -> DataFrame:
    """``(table_uid, headers, depth)``.  A first row with spans takes the second row
    as its finer headers (depth 2); a column without any is "column_n"."""
    told = F.when(F.col("row") < 2, T.nfkc(T.blank(F.col("text"))))
    top = cells.select("table_uid", "row", "col", _span(cells, "col_span").alias("span"), told.alias("text"))
    listed = lambda row: F.array_sort(F.collect_list(F.when(F.col("row") == row, F.struct("col", "span", "text"))))
    t = top.groupBy("table_uid").agg(F.max(F.col("col") + F.col("span")).alias("n"), listed(0).alias("first"), listed(1).alias("second"))
    spans = F.exists("first", lambda c: c["span"] > 1)
    finer = F.filter("second", lambda c: F.trim(c["text"]) != "")
    t = t.withColumns({"finer": F.when(spans, finer).otherwise(F.slice(finer, 1, 0))})

    def name(c: Column) -> Column:
        group = F.coalesce(_last(F.filter("first", lambda x: (x["col"] <= c) & (c < x["col"] + x["span"]))["text"]), F.lit(""))
        own = F.trim(F.coalesce(_last(F.filter("finer", lambda x: x["col"] == c)["text"]), F.lit("")))
        said = F.when(group == own, group).otherwise(F.trim(F.concat_ws(" ", F.nullif(group, F.lit("")), F.nullif(own, F.lit("")))))
        return labels.header(F.when(said == "", F.concat(F.lit("column_"), (c + 1).cast("string"))).otherwise(said), unicode=False)

    named = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), name)
    return t.select("table_uid", labels.fuse_headers(named).alias("headers"), F.when(F.size("finer") > 0, 2).otherwise(1).alias("depth"))


def plain_headers(cells: DataFrame) -> DataFrame:
    """``(table_uid, headers)`` of the first row as it stands."""
    first = F.array_sort(F.collect_list(F.struct("col", "text")))
    return cells.where("row = 0").groupBy("table_uid").agg(F.transform(first, lambda x: x["text"]).alias("headers"))


def without_caption_row(cells: DataFrame) -> DataFrame:
    """Cells without a first row that is a caption: one cell over all columns but one
    at most, which begins with "Table n" or "Figure n".  The other rows move up."""
    of = W.partitionBy("table_uid")
    span = _span(cells, "col_span")
    wide = F.greatest(F.lit(1), F.max(F.col("col") + span).over(of) - 1)
    is_caption = (F.col("row") == 0) & F.trim("text").rlike("(?iU)" + L.CAPTION_ROW) & (span >= wide) & (F.count_if(F.col("row") == 0).over(of) == 1)
    marked = cells.withColumn("_caption", is_caption).withColumn("_moved", F.max("_caption").over(of))
    return marked.where("not _caption").withColumn("row", F.col("row") - F.when(F.col("_moved"), 1).otherwise(0)).drop("_caption", "_moved")


def verdicts(cells: DataFrame, conservative: bool = False) -> DataFrame:
    """``(table_uid, n_rows, n_cols, density, reason)``: why a table is none (null if
    it is one).  ``section`` is a column of the cells; ``conservative`` passes over
    size, density and list tests."""
    filled = F.trim(T.blank(F.col("text"))) != ""
    t = cells.groupBy("table_uid").agg(
        F.max("section").alias("section"), (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count("*").alias("n"),
        F.count_if(filled).alias("filled"), F.countDistinct(F.when(filled, F.col("col"))).alias("used"), F.count_if(F.col("col") == 0).alias("keys"),
        F.count_if((F.col("col") == 0) & F.col("text").rlike(L.LIST_MARKER_CELL)).alias("marks"),
        F.max(F.when((F.col("row") == 0) & (F.col("col") == 0), F.length("text"))).alias("width"),
    )
    section = T.blank(F.col("section"))
    shape = [
        ((F.col("n_rows") < 2) | (F.col("n_cols") < 2), F.lit("too_small")),
        (F.col("n") < 0.4 * F.col("n_rows") * F.col("n_cols"), F.lit("sparse")),
        ((F.col("keys") > 0) & (F.col("marks") >= 0.7 * F.col("keys")), F.lit("list")),
        (F.col("used") <= 2, F.lit("list")),
    ]
    reason = ladder(
        [
            (section.rlike("(?iU)" + L.TABLE_CAPTION_NUMBER), F.lit(None)),
            (section.rlike("(?iU)" + L.REFERENCE_SECTION), F.lit("reference_section")),
            *([] if conservative else shape),
            ((F.col("n_cols") == 1) & (F.col("width") > 80), F.lit("sentence_header")),
        ],
        F.lit(None),
    )
    return t.select("table_uid", "n_rows", "n_cols", F.round(F.col("filled") / F.col("n"), 6).alias("density"), reason.alias("reason"))


def header_repeats(tables: DataFrame, share: float = 0.6) -> DataFrame:
    """``(doc, table_uid, next_uid)``: tables whose next one lies on the next page and
    repeats most headers; of ``tables(doc, ord, table_uid, page, headers)``."""
    w = W.partitionBy("doc").orderBy("ord")
    plain = F.array_distinct(F.filter(F.transform("headers", lambda h: F.lower(F.trim(T.blank(h)))), lambda h: h != ""))
    t = tables.select("doc", "ord", "table_uid", "page", plain.alias("mine"))
    t = t.withColumns({"next_uid": F.lead("table_uid").over(w), "next_page": F.lead("page").over(w), "theirs": F.lead("mine").over(w)})
    both = F.size(F.array_intersect("mine", "theirs"))
    return t.where((F.col("next_page") == F.col("page") + 1) & (F.size("mine") > 0) & (both >= share * F.size("mine"))).select("doc", "table_uid", "next_uid")


def continuation_signals(caption: Column, texts: Column, pages: Column) -> Column:
    """What says that a table goes on: its caption, a cell, its pages."""
    near = (F.size(F.array_distinct(pages)) > 1) & (F.array_max(pages) - F.array_min(pages) <= 2)
    return F.array_compact(
        F.array(
            F.when(T.blank(caption).rlike("(?iU)" + L.CONTINUED), "caption_continued_marker"),
            F.when(F.exists(texts, lambda x: F.contains(F.lower(T.blank(x)), F.lit("continued"))), "content_continued_marker"),
            F.when(near, "page_split"),
        )
    )


def table_name(caption: Column, n: Column) -> Column:
    """``tbl_<caption>_<n>``, the caption without continuation and page marks."""
    bare = F.regexp_replace(F.regexp_replace(T.blank(caption), "(?iU)" + L.CONTINUED, ""), "(?iU)" + L.PAGE_BREAK, "")
    return F.concat(F.lit("tbl_"), F.regexp_replace(F.regexp_replace(T.normalize(bare), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.format_string("_%03d", n))


def real_headers(names: Column) -> Column:
    return F.size(F.filter(names, lambda h: (T.blank(h) != "") & ~h.rlike(L.PLACEHOLDER_HEADER)))


def candidate_score(c: str = "") -> Column:
    """Of a candidate with confidence, headers, n_cols and backend: confidence .40,
    headers that name something .30 + .10, backend .20."""
    col = lambda n: F.col(f"{c}.{n}" if c else n)
    named = real_headers(col("headers")) / F.greatest(col("n_cols"), F.lit(1))
    weight = ladder([(F.lower(col("backend")) == k, F.lit(v)) for k, v in L.BACKEND_WEIGHTS.items()], F.lit(0.5))
    return 0.40 * col("confidence") + 0.30 * named + 0.20 * weight + 0.10 * named


def best_candidates(candidates: DataFrame, group: str) -> DataFrame:
    """Of each group the candidate of the highest score; of equals the smallest id."""
    scored = candidates.withColumn("score", F.round(candidate_score(), 6))
    rows = F.struct("score", (-F.col("id")).alias("_order"), *[c for c in scored.columns if c not in ("score", group)])
    return scored.groupBy(group).agg(F.max(rows).alias("best")).select(group, "best.*").drop("_order")


def replaces(confidence: Column, names: Column, n_rows: Column, n_cols: Column, current: Column) -> Column:
    """Whether a candidate is better than the table at hand."""
    named = (F.size(names) > 0) & (real_headers(names) >= 0.5 * F.size(names))
    perfect = (F.size(current) > 0) & (real_headers(current) == F.size(current))
    return (confidence >= 0.7) & named & (n_rows >= 2) & (n_cols >= 2) & ~perfect


def content_hash(cells: DataFrame) -> DataFrame:
    """``(table_uid, content_hash)`` of the texts in order."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda x: T.normalize(x["text"]))
    return cells.groupBy("table_uid").agg(F.sha2(F.array_join(F.filter(sorted_, lambda x: x != ""), "|"), 256).alias("content_hash"))


def generic_key(c: Column) -> Column:
    """struct(requirement_id, test_case_id, condition, step) of a row's text."""
    first = lambda patterns: F.coalesce(*[F.nullif(F.regexp_extract(c, "(?iU)" + p, 1), F.lit("")) for p in patterns], F.lit(""))
    low = F.lower(T.blank(c))
    word = lambda words: ladder([(F.contains(low, F.lit(k)), F.lit(k.replace(" ", "_"))) for k in words])
    numbered = F.regexp_extract(low, r"(?U)(?:step|phase|stage|part)\s+(\d+|[a-z])", 1)
    step = F.when(numbered != "", F.concat(F.lit("step_"), numbered)).otherwise(word(L.ROW_STEPS))
    return F.struct(first(L.REQUIREMENT_IDS).alias("requirement_id"), first(L.TEST_CASE_IDS).alias("test_case_id"), word(L.ROW_CONDITIONS).alias("condition"), step.alias("step"))


def domain_keys(cells: DataFrame, named: DataFrame) -> DataFrame:
    """``(table_uid, row, key)`` by the key columns of the table's test type:
    ``named(table_uid, test_type, headers)``.  A column is found by its header's entity,
    else by its name."""

    def place(part: str) -> Column:
        at = lambda test: F.filter(F.transform("headers", lambda h, i: F.when(test(h), i)), lambda i: i.isNotNull())
        entity = L.KEY_ENTITIES.get(part)
        words = part.replace("_", " ")
        by_name = F.get(at(lambda h: F.contains(F.lower(h), F.lit(words)) | (F.contains(F.lit(words), F.lower(h)) & (h != ""))), 0)
        by_entity = _last(F.filter(F.transform("entities", lambda e, i: F.when(e == entity, i)), lambda i: i.isNotNull())) if entity else F.lit(None)
        return F.coalesce(by_entity, by_name)

    # One row a table: small next to its cells.
    found = named.withColumn("entities", F.transform("headers", ontology.header_entity))
    found = found.select("table_uid", ladder([(F.col("test_type") == k, F.array(*map(place, v))) for k, v in L.DOMAIN_ROW_KEYS.items()], F.lit(None)).alias("places"))
    found = found.where("places is not null").select("table_uid", F.posexplode("places").alias("part", "col")).where("col is not null")
    part = F.substring(F.replace(F.lower(F.trim("text")), F.lit(" "), F.lit("_")), 1, 40)
    met = cells.join(found, ["table_uid", "col"]).groupBy("table_uid", "row").agg(F.array_sort(F.collect_list(F.struct("part", part.alias("said")))).alias("parts"))
    key = F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["said"]), ":"), ":+$", "")
    return met.select("table_uid", "row", key.alias("key")).where("key <> ''")


def column_changes(old: Column, new: Column) -> Column:
    """struct(added, removed, renamed): sorted names; a removed and an added header of
    one entity are a rename, each once and in the order of names."""
    gone, come = F.array_sort(F.array_except(old, new)), F.array_sort(F.array_except(new, old))
    known = lambda names: F.transform(names, lambda h: F.struct(h.alias("name"), ontology.header_entity(h).alias("entity")))
    empty = F.array().cast("array<struct<old:string,new:string,entity:string>>")

    def pair(done: Column, x: Column) -> Column:
        free = F.filter(known(come), lambda y: (y["entity"] == x["entity"]) & ~F.exists(done, lambda r: r["new"] == y["name"]))
        made = F.struct(x["name"].alias("old"), F.get(free, 0)["name"].alias("new"), x["entity"].alias("entity"))
        return F.when(F.size(free) > 0, F.array_append(done, made)).otherwise(done)

    def split(renamed: Column) -> Column:
        left = lambda names, side: F.array_except(names, F.transform(renamed, lambda r: r[side]))
        return F.struct(left(come, "new").alias("added"), left(gone, "old").alias("removed"), renamed.alias("renamed"))

    return T.let(F.aggregate(known(gone), empty, pair), split)


def structural_changes(old: Column, new: Column) -> Column:
    """Of struct(section, is_split, caption, headers)."""
    a, b = old["headers"], new["headers"]
    reordered = (a != b) & (F.size(a) == F.size(b)) & (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))
    return F.array_compact(
        F.array(
            F.when(~old["section"].eqNullSafe(new["section"]), "moved_section"),
            F.when(~old["is_split"] & new["is_split"], "split_across_pages").when(old["is_split"] & ~new["is_split"], "merged_from_split"),
            F.when(~old["caption"].eqNullSafe(new["caption"]), "caption_changed"),
            F.when(reordered, "columns_reordered"),
        )
    )


def diff_type(similarity: Column, structural: Column, n_columns: Column, n_rows: Column, n_modified: Column) -> Column:
    """The kind of a table's difference: n_columns and n_rows were added or removed."""
    has = lambda *names: F.arrays_overlap(structural, F.array(*map(F.lit, names)))
    return ladder(
        [
            ((similarity > 0.99) & (F.size(structural) == 0), F.lit("identical")),
            (has("moved_section"), F.lit("moved")),
            (has("caption_changed"), F.lit("renamed")),
            (has("split_across_pages", "merged_from_split"), F.lit("structural_changed")),
            (n_columns > 0, F.lit("column_changed")),
            (n_rows > 0, F.lit("row_changed")),
            (n_modified > 0, F.lit("cell_changed")),
        ],
        F.lit("identical"),
    )


def impact(kind: Column, structural: Column, entities: Column, n_columns: Column, n_rows: Column, n_modified_rows: Column, n_cells: Column) -> Column:
    """How much a difference matters; a changed critical entity is always high."""
    still = (n_cells == 0) & (n_modified_rows == 0)
    labels_only = F.size(F.array_except(structural, F.array(F.lit("caption_changed"), F.lit("moved_section")))) == 0
    return ladder(
        [
            (kind == "identical", F.lit("identical")),
            (F.arrays_overlap(entities, F.array(*map(F.lit, CRITICAL))), F.lit("high")),
            (still & (n_rows == 0) & (n_columns == 0) & labels_only, F.lit("low")),
            ((n_rows > 0) & (n_cells < 5), F.lit("medium")),
            (~still, F.lit("high")),
            (kind.isin("column_changed", "row_changed"), F.lit("medium")),
        ],
        F.lit("high"),
    )


def _bags(cells: DataFrame, side: str) -> DataFrame:
    return cells.select("table_uid", "row", "col", T.normalize(F.col("text")).alias(side))


def grid_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(table_uid, similarity)``: Dice of cells equal at their places, less half the
    share of columns that one side lacks."""
    shape = lambda d, s: d.groupBy("table_uid").agg(F.count("*").alias(f"{s}n"), F.countDistinct("col").alias(f"{s}c"))
    met = _bags(left, "l").join(_bags(right, "r"), ["table_uid", "row", "col"]).groupBy("table_uid").agg(F.count_if(F.col("l") == F.col("r")).alias("same"))
    t = shape(left, "l").join(shape(right, "r"), "table_uid").join(met, "table_uid", "left").na.fill(0, ["same"])
    lacking = F.abs(F.col("lc") - F.col("rc")) / F.greatest("lc", "rc")
    return t.select("table_uid", F.round(2.0 * F.col("same") / (F.col("ln") + F.col("rn")) * (1 - 0.5 * lacking), 6).alias("similarity"))


def match_tables(left: DataFrame, right: DataFrame, block: str, gate: float = 0.65) -> DataFrame:
    """``(block, l_uid, r_uid, similarity)``: each left table's match within its block,
    by uid, else by the best similarity above the gate (of equals the smallest uid);
    r_uid is null without one.  Only tables with an equal cell at an equal place
    meet; tables without a common cell have no similarity."""
    named = lambda d, s: d.select(block, "row", "col", F.col("table_uid").alias(f"{s}_uid"), T.normalize(F.col("text")).alias("said"))
    size = lambda d, s: d.groupBy(block, F.col("table_uid").alias(f"{s}_uid")).agg(F.count("*").alias(f"{s}n"), F.countDistinct("col").alias(f"{s}c"))
    same = size(left, "l").join(size(right, "r"), block).where("l_uid = r_uid").select(block, "l_uid", "r_uid", F.lit(1.0).alias("similarity"))
    rest = named(left, "l").join(same.select(block, "l_uid"), [block, "l_uid"], "left_anti")
    met = rest.join(named(right, "r"), [block, "row", "col", "said"]).groupBy(block, "l_uid", "r_uid").agg(F.count("*").alias("n"))
    met = met.join(size(left, "l"), [block, "l_uid"]).join(size(right, "r"), [block, "r_uid"])
    lacking = F.abs(F.col("lc") - F.col("rc")) / F.greatest("lc", "rc")
    scored = met.select(block, "l_uid", "r_uid", F.round(2.0 * F.col("n") / (F.col("ln") + F.col("rn")) * (1 - 0.5 * lacking), 6).alias("similarity")).where(F.col("similarity") > gate)
    best = scored.groupBy(block, "l_uid").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "r_uid")).alias("b")).select(block, "l_uid", F.col("b.r_uid").alias("r_uid"), (-F.col("b.s")).alias("similarity"))
    every = left.select(block, F.col("table_uid").alias("l_uid")).distinct()
    return every.join(same.unionByName(best), [block, "l_uid"], "left")


def positional_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(table_uid, row, col, change, old, new)``: cells that differ at their place, and
    cells of rows beyond the left table's; a caption row counts for neither."""
    a, b = without_caption_row(left), without_caption_row(right)
    height = a.groupBy("table_uid").agg((F.max("row") + 1).alias("height"))
    x = a.select("table_uid", "row", "col", F.trim("text").alias("old"))
    y = b.select("table_uid", "row", "col", F.trim("text").alias("new"))
    met = y.join(x, ["table_uid", "row", "col"], "left").join(height, "table_uid")
    change = F.when(F.col("old").isNotNull() & (F.col("old") != F.col("new")), "modified").when(F.col("old").isNull() & (F.col("new") != "") & (F.col("row") >= F.col("height")), "added")
    return met.select("table_uid", "row", "col", change.alias("change"), "old", "new").where("change is not null")


def severity(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(table_uid, jaccard, overlap, severity)`` of tables in both versions: by the
    sets of their texts, then by places whose texts are equal or nearly (0.85)."""
    a, b = _bags(without_caption_row(left), "l"), _bags(without_caption_row(right), "r")
    bag = lambda d, s: d.groupBy("table_uid").agg(F.collect_set(s).alias(f"{s}s"))
    both = bag(a, "l").join(bag(b, "r"), "table_uid").select("table_uid", F.round(T.jaccard(F.col("ls"), F.col("rs")), 6).alias("jaccard"))
    met = a.join(b, ["table_uid", "row", "col"], "full").na.fill("", ["l", "r"])
    differ = (F.col("l") != F.col("r")) & (F.col("l") != "") & (F.col("r") != "")
    close = F.when(F.col("l") == F.col("r"), F.col("l") != "").otherwise(differ & (matching.ratio(F.when(differ, F.col("l")), F.when(differ, F.col("r"))) >= 0.85))
    share = met.groupBy("table_uid").agg(F.round(F.count_if(close) / F.count("*"), 6).alias("overlap"))
    said = F.when((F.col("jaccard") >= 0.90) | (F.col("overlap") >= 0.85), "low").when((F.col("jaccard") >= 0.60) | (F.col("overlap") >= 0.50), "medium").otherwise("high")
    return both.join(share, "table_uid").withColumn("severity", said)


def entity_profiles(cells: DataFrame, named: DataFrame) -> DataFrame:
    """``(table_uid, row, entity, value)``: the facts of each row, the first of each name
    by column.  Cells are searched for facts, then for a bare range or number in the unit
    of their header; facts less sure than 0.80 do not count.
    ``named(table_uid, headers)``."""
    columns = named.select("table_uid", F.posexplode("headers").alias("col", "header"))
    c = cells.join(columns, ["table_uid", "col"]).withColumn("unit", labels.column_unit(F.col("header")))
    told = F.when(F.col("unit").isNotNull(), F.col("header")).otherwise("")
    c = c.withColumn("facts", ontology.facts(F.trim("text"), told))
    ranged = F.when(F.col("unit.fact_type") == "frequency_range", labels.bare_range(F.col("text"), F.col("unit.unit")))
    bare = F.nullif(F.regexp_extract(F.trim("text"), r"^([+-]?\d+(?:[.,]\d+)?)$", 1), F.lit(""))
    number = F.when(bare.isNotNull() & F.col("unit").isNotNull(), F.trim(F.concat_ws(" ", F.replace(bare, F.lit(","), F.lit(".")), F.col("unit.unit"))))
    pair = lambda n, v: F.struct(n.alias("entity"), v.alias("value"))
    sure = F.transform(F.filter("facts", lambda f: f["confidence"] >= 0.80), lambda f: pair(f["name"], F.trim(F.concat_ws(" ", f["value"], f["unit"]))))
    inherited = F.array_compact(F.array(F.when(ranged.isNotNull(), pair(F.lit("frequency_range"), ranged)).when(number.isNotNull(), pair(F.col("unit.fact_type"), number))))
    said = F.when(F.size("facts") > 0, sure).otherwise(inherited)
    rows = c.select("table_uid", "row", "col", F.posexplode(said).alias("seq", "fact"))
    return rows.groupBy("table_uid", "row", F.col("fact.entity").alias("entity")).agg(F.min_by("fact.value", F.struct("col", "seq")).alias("value"))


def entity_changes(left: DataFrame, right: DataFrame, key: str = "frequency_range") -> DataFrame:
    """``(table_uid, entity, old, new, change, row_old, row_new)`` of two profiles: rows
    meet by their value of ``key`` (of equal values the last old row), else by position."""

    def by_row(profiles: DataFrame, s: str) -> DataFrame:
        facts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "value"))))
        p = profiles.groupBy("table_uid", "row").agg(facts.alias(f"{s}_facts"))
        return p.select("table_uid", F.col("row").alias(f"row_{s}"), f"{s}_facts", F.col(f"{s}_facts")[key].alias("pk"))

    old, new = by_row(left, "old"), by_row(right, "new")
    last = old.where("pk is not null").groupBy("table_uid", "pk").agg(F.max("row_old").alias("keyed"))
    met = new.join(last, ["table_uid", "pk"], "left").drop("pk").withColumn("row_old", F.coalesce("keyed", "row_new")).drop("keyed")
    pairs = met.join(old.drop("pk"), ["table_uid", "row_old"], "left")
    used = pairs.where("old_facts is not null").select("table_uid", "row_old").distinct()
    gone = old.join(used, ["table_uid", "row_old"], "left_anti").select("table_uid", "row_old", F.lit(None).cast("bigint").alias("row_new"), "old_facts", F.lit(None).cast("map<string,string>").alias("new_facts"))
    every = pairs.withColumn("row_old", F.when(F.col("old_facts").isNotNull(), F.col("row_old"))).unionByName(gone)
    none = F.create_map().cast("map<string,string>")
    zipped = F.map_zip_with(F.coalesce("old_facts", none), F.coalesce("new_facts", none), lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    changes = every.select("table_uid", "row_old", "row_new", F.explode(zipped).alias("entity", "v")).where("not v.old <=> v.new")
    kind = F.when(F.col("v.old").isNull(), "added").when(F.col("v.new").isNull(), "removed").otherwise("modified")
    return changes.select("table_uid", "entity", "v.old", "v.new", kind.alias("change"), "row_old", "row_new")


def html(cells: DataFrame, named: DataFrame) -> DataFrame:
    """``(table_uid, html)``: a table with its headers, cells and spans, escaped."""
    safe = lambda c: reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), T.blank(c))
    attr = lambda n, c: F.when(c > 1, F.concat(F.lit(f' {n}="'), c.cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), attr("rowspan", _span(cells, "row_span")), attr("colspan", _span(cells, "col_span")), F.lit(">"), safe(F.col("text")), F.lit("</td>"))
    joined = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), "")
    rows = cells.withColumn("piece", cell).groupBy("table_uid", "row").agg(F.concat(F.lit("<tr>"), joined("col"), F.lit("</tr>")).alias("piece"))
    body = rows.groupBy("table_uid").agg(joined("row").alias("body"))
    head = F.array_join(F.transform("headers", lambda h: F.concat(F.lit("<th>"), safe(h), F.lit("</th>"))), "")
    page = F.concat(F.lit('<table class="canonical-table"><thead><tr>'), head, F.lit("</tr></thead><tbody>"), F.col("body"), F.lit("</tbody></table>"))
    return body.join(named, "table_uid").select("table_uid", page.alias("html"))


def classify(cells: DataFrame, named: DataFrame, caption: str = "") -> DataFrame:
    """``named`` with ``test_type``, by the caption column and the headers."""
    said = F.concat_ws(" ", *([caption] if caption else []), F.array_join("headers", " "))
    return named.withColumn("test_type", S.test_type(said))


def fact_cells(cells: DataFrame, named: DataFrame) -> DataFrame:
    """``(table_uid, row, col, text, semantic_key, facts)``: each cell with the entity of
    its header and the facts in it; without any, a bare number under a header with a
    unit of its own is a fact in that unit, at a confidence of 0.75.
    ``named(table_uid, headers)``; cells beyond the headers have neither key nor unit."""
    columns = named.select(F.col("table_uid").alias("_t"), F.posexplode("headers").alias("_c", "header"))
    entity = ontology.header_entity(F.col("header"))
    met = cells.join(columns, (F.col("table_uid") == F.col("_t")) & (F.col("col") == F.col("_c")), "left").withColumn("semantic_key", entity)
    met = met.withColumns({"found": ontology.facts(T.blank(F.col("text")), T.blank(F.col("header"))), "unit": ontology.default_unit(F.col("semantic_key"))})
    number = F.nullif(F.regexp_extract(T.blank(F.col("text")), r"(?U)^\s*[±+\-]?\s*(\d+(?:[.,]\d+)?)\s*$", 1), F.lit(""))
    kind = ladder([(F.col("semantic_key") == k, F.lit(v)) for k, v in L.INHERITED_FACTS.items()], F.lit(None))
    bare = F.struct(
        kind.alias("fact_type"), kind.alias("name"), F.replace(number, F.lit(","), F.lit(".")).alias("value"), F.col("unit").alias("unit"), F.trim("text").alias("raw_value"), F.lit(0.75).alias("confidence")
    )
    inherits = (F.size("found") == 0) & number.isNotNull() & kind.isNotNull() & F.col("unit").isNotNull()
    return met.select("table_uid", "row", "col", "text", "semantic_key", F.when(inherits, F.array(bare)).otherwise(F.col("found")).alias("facts"))


def table_test_types(tables: DataFrame) -> DataFrame:
    """``(table_uid, test_type)`` of ``tables(table_uid, caption, headers, section)``: what
    the caption and the headers tell, else the section."""
    shown = S.test_type(F.concat_ws(" ", T.blank(F.col("caption")), F.array_join("headers", " ")))
    return tables.select("table_uid", F.when(shown != "unknown", shown).otherwise(S.test_type(F.col("section"))).alias("test_type"))
