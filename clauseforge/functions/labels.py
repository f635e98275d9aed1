"""Labels of sections, captions, headers, cells and nodes as Column expressions.
Null texts count as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseforge.functions import lexicon as L
from clauseforge.functions import ontology
from clauseforge.functions import text as T
from clauseforge.functions.semantics import ladder
from clauseforge.functions.text import blank, let

FLAGS = "(?iU)"
TEXT_TYPES = ("clause", "paragraph", "list_item", "definition", "note", "warning")


def _group(c: Column, pattern: str, n: int = 1) -> Column:
    """The group of the first match, null without a match."""
    return F.nullif(F.regexp_extract(blank(c), FLAGS + pattern, n), F.lit(""))


def section_label(title: Column, section: Column, heading: Column) -> Column:
    """The number that begins the title, else the section, else the heading, its
    parts joined by dots; null if none has one."""
    return F.replace(F.coalesce(*[_group(c, L.SECTION_LABEL) for c in (title, section, heading)]), F.lit("-"), F.lit("."))


def section_title(c: Column) -> Column:
    """A title without its number and keyword; a title of nothing else stays."""
    bare = F.trim(F.regexp_replace(blank(c), FLAGS + L.SECTION_NUMBER, ""))
    return F.when(bare == "", blank(c)).otherwise(bare)


def glossary_text(comparable: Column, node_type: Column, headings: Column) -> Column:
    """Comparable text; of definitions and below glossary headings "term: definition"."""
    listed = (blank(node_type) == "definition") | F.exists(F.coalesce(headings, F.array().cast("array<string>")), lambda h: F.lower(blank(h)).rlike("glossary|definition"))
    term = F.trim(F.regexp_extract(comparable, "(?sU)" + L.GLOSSARY_TERM, 1), F.lit(" :"))
    said = F.trim(F.regexp_extract(comparable, "(?sU)" + L.GLOSSARY_TERM, 2))
    return F.when(listed & (term != "") & (said != ""), F.concat(term, F.lit(": "), said)).otherwise(comparable)


def caption(c: Column) -> Column:
    """A caption without decoration and its "Table n:", in lower case."""
    plain = F.regexp_replace(blank(c), r"\*{1,3}|_{1,3}", "")
    bare = F.trim(F.regexp_replace(plain, FLAGS + L.TABLE_PREFIX, ""))
    return T.normalize(F.when(bare == "", plain).otherwise(bare))


def caption_number(path: Column) -> Column:
    """The first table number in an array of headings, null without one."""
    numbers = F.transform(path, lambda h: F.lower(F.regexp_extract(blank(h), FLAGS + L.TABLE_NUMBER, 1)))
    return F.get(F.filter(numbers, lambda n: n != ""), 0)


def is_running_code(c: Column) -> Column:
    """At most twelve characters, three in five of them digits."""
    return let(T.collapse(c), lambda t: (t != "") & (F.length(t) <= 12) & (F.length(F.regexp_replace(t, r"(?U)\D", "")) >= 0.6 * F.length(t)))


def list_text(c: Column, is_item: Column) -> Column:
    """A list item without doubled dash markers."""
    return F.when(is_item, F.trim(F.regexp_replace(blank(c), r"(?:(?<=\s)|^)- -\s*", ""))).otherwise(blank(c))


def cell_text(c: Column, unicode: bool = True) -> Column:
    return T.comparable(F.regexp_replace(F.regexp_replace(blank(c), r"[ \t]+", " "), r"\n{2,}", "\n"), unicode)


def header(c: Column, unicode: bool = True) -> Column:
    """``unicode``: c is not in NFKC yet (inside a lambda it has to be)."""
    return T.normalize(cell_text(c, unicode))


def fuse_headers(headers: Column) -> Column:
    """Joins each header that ends in a hyphen with the next, which becomes empty.
    A header that was joined to the one before does not join the next."""
    word = lambda h: F.trim(F.regexp_replace(h, r"-\s*$", ""))

    def step(done: Column, h: Column) -> Column:
        fuse = done["open"]
        last = F.element_at(done["out"], -1)
        kept = F.slice(done["out"], 1, F.greatest(F.size(done["out"]) - 1, F.lit(0)))
        joined = F.concat(kept, F.array(F.trim(F.concat(word(last), h)), F.lit("")))
        out = F.when(fuse, joined).otherwise(F.concat(done["out"], F.array(h)))
        return F.struct(out.alias("out"), (~fuse & h.rlike(r"-\s*$")).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))
    return F.aggregate(headers, start, step, lambda done: done["out"])


def markdown_text(c: Column) -> Column:
    """The comparable form of text with Markdown tables, separator rows dropped."""
    return T.comparable(F.regexp_replace(blank(c), "(?m)" + L.TABLE_SEPARATOR, ""))


def node_type(raw: Column, labels: Column, title: Column, section: Column) -> Column:
    """Clauses become list items, definitions, notes, warnings or paragraphs by
    their labels, title and section; other types pass."""
    kind = F.lower(F.trim(F.coalesce(raw, F.lit("paragraph"))))
    told = F.lower(F.array_join(F.coalesce(labels, F.array().cast("array<string>")), " "))
    note = F.lower(F.regexp_extract(F.concat_ws(" ", told, blank(title)), FLAGS + L.NOTE_LABEL, 1))
    refined = (
        F.when(told.rlike("list|bullet"), "list_item")
        .when(F.contains(told, F.lit("definition")) | F.contains(F.lower(blank(section)), F.lit("glossary")), "definition")
        .when(note.isin("warning", "caution"), "warning")
        .when(note != "", "note")
        .otherwise("paragraph")
    )
    return F.when(kind == "clause", refined).otherwise(kind)


def suppression(label: Column, c: Column) -> Column:
    """Why a node takes no part in comparisons; null for those that do."""
    known = ladder([(F.lower(F.trim(blank(label))) == k, F.lit(v)) for k, v in L.SUPPRESSED_LABELS.items()], F.lit(None))
    return F.coalesce(known, F.when(F.length(F.trim(blank(c))) < 5, "ocr_fragment"))


def label_type(label: Column) -> Column:
    """The node type of an extractor's label, null for unknown labels."""
    return ladder([(F.lower(F.trim(blank(label))) == k, F.lit(v)) for k, v in L.NODE_TYPES.items()], F.lit(None))


def department(c: Column) -> Column:
    t = F.trim(blank(c))
    return F.when(t.isin(*L.DEPARTMENTS), t).otherwise("EMC")


def obligation_value(c: Column) -> Column:
    """The obligation that a free answer names, prohibitions first."""
    t = F.lower(blank(c))
    forbids = t.rlike("not|never|prohibit|forbid")
    says = lambda w: t.rlike(w)
    return ladder(
        [
            (says("shall") & forbids, F.lit("shall_not")),
            (says("must") & forbids, F.lit("must_not")),
            (says("prohibit|forbid"), F.lit("must_not")),
            (says("shall"), F.lit("shall")),
            (says("must"), F.lit("must")),
            (says("require|mandatory|obligat"), F.lit("required")),
            (says("recommend"), F.lit("recommended")),
            (says("should"), F.lit("should")),
            (says("may|optional"), F.lit("may")),
        ]
    )


def normative_change(left: Column, right: Column) -> Column:
    """'strengthened' or 'weakened' by the first normative term of two texts; null
    where a side has none that is ranked or both rank alike."""

    def rank(c: Column) -> Column:
        term = F.lower(F.trim(F.regexp_extract(blank(c), FLAGS + L.FACT_TERM, 0)))
        return ladder([(term == k, F.lit(v)) for k, v in L.OBLIGATION_STRENGTH.items()], F.lit(None))

    return let(F.struct(rank(left).alias("a"), rank(right).alias("b")), lambda s: F.when(s["b"] > s["a"], "strengthened").when(s["b"] < s["a"], "weakened"))


def is_reference_section(path: Column, is_table: Column) -> Column:
    """Whether a table lies under a legend, glossary or annex and has no number."""
    joined = F.array_join(path, " / ")
    return is_table & joined.rlike(FLAGS + L.REFERENCE_SECTION) & ~joined.rlike(FLAGS + L.TABLE_NUMBER)


def column_unit(c: Column) -> Column:
    """struct(unit, fact_type) that a header tells, by its text, then by the default
    unit of its entity; null without."""
    h = F.lower(blank(c))
    made = lambda u, f: F.struct(u.alias("unit"), f.alias("fact_type"))
    by_text = reduce(lambda w, p: w.when(h.rlike(FLAGS + p[0]), made(F.lit(p[1]), F.lit(p[2]))), L.COLUMN_UNITS, F.when(F.lit(False), made(F.lit(""), F.lit(""))))
    entity = ontology.header_entity(c)
    return F.coalesce(by_text, F.when(entity.isin(*L.DEFAULT_UNITS), made(ontology.default_unit(entity), F.lower(entity))))


def bare_range(c: Column, unit: Column) -> Column:
    """'low-highHz' of a cell that is no more than two rising numbers; else null."""
    t, each = F.trim(blank(c)), FLAGS + L.BARE_RANGE
    factor = ladder([(F.lower(blank(unit)) == k, F.lit(v)) for k, v in L.FREQUENCY_FACTORS.items()], F.lit(1.0))
    plain = lambda n: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(t, each, n)), r"(\d)\s*,\s*(\d)", "$1.$2"), ",", ".").try_cast("double")
    low, high = plain(1), plain(2)
    whole = lambda x: F.round(x * factor, 0).cast("decimal(38,0)").cast("string")
    return F.when(low < high, F.concat(whole(low), F.lit("-"), whole(high), F.lit("Hz")))


def range_change(old: Column, new: Column) -> Column:
    """How struct(low, high) ranges differ."""
    wider = (new["low"] <= old["low"]) & (new["high"] >= old["high"])
    narrower = (new["low"] >= old["low"]) & (new["high"] <= old["high"])
    said = F.when(wider & narrower, "unchanged").when(wider, "expanded").when(narrower, "restricted").otherwise("shifted")
    return F.concat(F.lit("frequency_range_"), said)


def compatible(left: Column, right: Column) -> Column:
    """Whether nodes of two types may match."""
    a, b = F.coalesce(left, F.lit("paragraph")), F.coalesce(right, F.lit("paragraph"))
    return (a == b) | (a.isin(*TEXT_TYPES) & b.isin(*TEXT_TYPES))


def depth_score(left: Column, right: Column) -> Column:
    return F.when(left == right, 1.0).when(F.abs(left - right) == 1, 0.6).otherwise(0.2)


def questions(c: Column, most: int = 4) -> Column:
    """The lines of a model's answer without numbering, at most ``most``; an answer
    with none but text: its first 300 characters."""
    bare = F.transform(F.split(blank(c), r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d*\.*\)*-*•*", "")))
    found = F.slice(F.filter(bare, lambda x: x != ""), 1, most)
    whole = F.trim(blank(c))
    return F.when((F.size(found) == 0) & (whole != ""), F.array(F.substring(whole, 1, 300))).otherwise(found)


def told_change(c: Column) -> Column:
    """A model's answer; '' where it says that nothing changed."""
    bare = F.trim(F.lower(F.trim(blank(c))), F.lit("()."))
    return F.when(bare.isin(*L.NO_CHANGE), "").otherwise(F.trim(blank(c)))


def extraction_confidence(n_rows: Column, n_cols: Column, n_filled: Column) -> Column:
    """Likelihood that a grid is a table, by its size and the share of filled cells."""
    fill = F.coalesce(F.try_divide(n_filled, n_rows * n_cols), F.lit(0.0))
    small = F.when(n_rows < 2, -0.2).otherwise(0.0) + F.when(n_cols < 2, -0.2).otherwise(0.0)
    usual = F.when(n_rows.between(2, 100) & n_cols.between(2, 20), 0.2).otherwise(0.0)
    full = F.when(fill < 0.3, -0.3).when(fill > 0.7, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.lit(0.5) + small + usual + full, 6)))


def viewer_box(box: Column, page_height: Column, bottom_left: Column) -> Column:
    """struct(left, top, right, bottom) from the top of the page; pages without a
    height are 842 points high."""
    h = F.coalesce(page_height.cast("double"), F.lit(842.0))
    flip = lambda y: F.when(bottom_left, h - y).otherwise(y)
    return F.struct(box["l"].alias("left"), flip(box["t"]).alias("top"), box["r"].alias("right"), flip(box["b"]).alias("bottom"))


def table_line(section: Column, page: Column, change: Column, said: Column, review: Column) -> Column:
    """A change as a row of the report's Markdown table."""
    text = F.trim(blank(said))
    marked = F.when(review & ~text.startswith("⚠"), F.concat(F.lit("⚠ "), text)).otherwise(text)
    kind = F.concat(F.upper(F.substring(change, 1, 1)), F.lower(F.substring(change, 2, 1000)))
    return F.concat(F.lit("| "), F.concat_ws(" | ", section, F.coalesce(F.concat(F.lit("p."), page.cast("string")), F.lit("—")), kind, marked), F.lit(" |"))
