"""Literal values of label functions."""

import pytest
from pyspark.sql import functions as F

from clauseforge.functions import labels as B

lit, arr = F.lit, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")

CASES = [
    ("label", lambda: B.section_label(lit("Section 4-2 Scope"), lit("9 x"), lit(None)), "4.2"),
    ("label_second", lambda: B.section_label(lit(None), lit("Annex A1"), lit(None)), "A1"),
    ("label_none", lambda: B.section_label(lit("Scope"), lit(""), lit(None)), None),
    ("title", lambda: B.section_title(lit("3.1 Data Protection")), "Data Protection"),
    ("title_bare", lambda: B.section_title(lit("4.2")), "4.2"),
    ("glossary", lambda: B.glossary_text(lit("risk : chance of harm"), lit("definition"), arr()), "risk: chance of harm"),
    ("glossary_other", lambda: B.glossary_text(lit("risk : chance"), lit("clause"), arr("Scope")), "risk : chance"),
    ("caption", lambda: B.caption(lit("**Tabelle C – Risk Matrix**")), "risk matrix"),
    ("caption_only_number", lambda: B.caption(lit("Table 3")), "table 3"),
    ("caption_number", lambda: B.caption_number(arr("Scope", "Tabelle 5A x", "Tabelle 6")), "5a"),
    ("caption_english", lambda: B.caption_number(arr("Table 5")), None),
    ("running", lambda: B.is_running_code(lit("12/34")), True),
    ("not_running", lambda: B.is_running_code(lit("page twelve")), False),
    ("list", lambda: B.list_text(lit("- - first"), lit(True)), "first"),
    ("fuse", lambda: B.fuse_headers(arr("grenz-", "wert", "u")), ["grenzwert", "", "u"]),
    ("fuse_chain", lambda: B.fuse_headers(arr("a-", "b-", "c")), ["ab-", "", "c"]),
    ("fuse_last", lambda: B.fuse_headers(arr("a", "b-")), ["a", "b-"]),
    ("markdown", lambda: B.markdown_text(lit("| a | b |\n|---|---|\n| c | d |")), "| a | b | | c | d |"),
    ("node_list", lambda: B.node_type(lit("clause"), arr("bullet"), lit(""), lit("")), "list_item"),
    ("node_warning", lambda: B.node_type(lit("clause"), arr(), lit("Caution: hot"), lit("")), "warning"),
    ("node_other", lambda: B.node_type(lit("Table"), arr("list"), lit(""), lit("")), "table"),
    ("suppressed", lambda: B.suppression(lit("TOC"), lit("long text")), "toc"),
    ("fragment", lambda: B.suppression(lit("paragraph"), lit(" ab ")), "ocr_fragment"),
    ("kept", lambda: B.suppression(lit("paragraph"), lit("a sentence")), None),
    ("department", lambda: B.department(lit("EMV")), "EMC"),
    ("department_named", lambda: B.department(lit(" Safety ")), "Safety"),
    ("obligation_not", lambda: B.obligation_value(lit("Must never")), "must_not"),
    ("obligation", lambda: B.obligation_value(lit("mandatory")), "required"),
    ("obligation_none", lambda: B.obligation_value(lit(None)), ""),
    ("normative", lambda: B.normative_change(lit("it may"), lit("it shall")), "strengthened"),
    ("normative_same", lambda: B.normative_change(lit("it may"), lit("it may")), None),
    ("normative_none", lambda: B.normative_change(lit("it may"), lit("it is")), None),
    ("reference", lambda: B.is_reference_section(arr("Annex A"), lit(True)), True),
    ("reference_numbered", lambda: B.is_reference_section(arr("Annex A", "Tabelle 3"), lit(True)), False),
    ("unit", lambda: B.column_unit(lit("f in MHz"))["unit"], "MHz"),
    ("unit_default", lambda: B.column_unit(lit("Frequency range"))["unit"], "Hz"),
    ("unit_none", lambda: B.column_unit(lit("Remarks"))["unit"], None),
    ("range", lambda: B.bare_range(lit("0,15 bis 30"), lit("MHz")), "150000-30000000Hz"),
    ("range_falling", lambda: B.bare_range(lit("30 - 1"), lit("MHz")), None),
    ("range_none", lambda: B.bare_range(lit("30 MHz"), lit("MHz")), None),
    ("wider", lambda: B.range_change(F.struct(lit(1.0).alias("low"), lit(2.0).alias("high")), F.struct(lit(0.5).alias("low"), lit(2.0).alias("high"))), "frequency_range_expanded"),
    ("compatible", lambda: B.compatible(lit("note"), lit(None)), True),
    ("incompatible", lambda: B.compatible(lit("note"), lit("table")), False),
    ("questions", lambda: B.questions(lit("1. Why?\n\n2) How?\n- When?"), 2), ["Why?", "How?"]),
    ("no_change", lambda: B.told_change(lit("(No semantic change).")), ""),
    ("confidence", lambda: B.extraction_confidence(lit(3), lit(3), lit(9)), 0.8),
    ("confidence_small", lambda: B.extraction_confidence(lit(1), lit(1), lit(0)), 0.0),
    ("line", lambda: B.table_line(lit("Scope"), lit(None).cast("int"), lit("ADDED"), lit("x"), lit(True)), "| Scope | — | Added | ⚠ x |"),
]


@pytest.mark.parametrize("name,made,want", CASES, ids=[c[0] for c in CASES])
def test_label(spark, name, made, want):
    assert spark.range(1).select(made().alias("v")).collect()[0]["v"] == want
