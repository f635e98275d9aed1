"""Entities of column headers and measurements in table cells."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from clauseforge.functions import lexicon as L
from clauseforge.functions.semantics import ladder
from clauseforge.functions.text import blank, let

ALIASES = {a: entity for entity, names in L.HEADER_ALIASES for a in names.split("; ")}
STRENGTHS = {t: s for s, terms in L.NORMATIVE_TERMS.items() for t in terms.split("; ")}
LEAST_PART = 5
_TEXTS = ("fact_type", "name", "value", "unit", "raw_value")
FACT_TYPE = ArrayType(StructType([*(StructField(n, StringType()) for n in _TEXTS), StructField("confidence", DoubleType())]))


def header_entity(c: Column) -> Column:
    """A header's entity: its alias, without a final hyphen, then the first alias
    that holds it or lies in it (both of five characters or more); null for none."""

    def exact(h: Column) -> Column:
        return ladder([(h.isin(*[a for a, e in ALIASES.items() if e == entity]), F.lit(entity)) for entity in dict.fromkeys(ALIASES.values())], F.lit(None))

    long = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(e).alias("entity")) for a, e in ALIASES.items() if len(a) >= LEAST_PART])

    def partial(h: Column) -> Column:
        return F.when(F.length(h) >= LEAST_PART, F.get(F.filter(long, lambda x: F.contains(h, x["name"]) | F.contains(x["name"], h)), 0)["entity"])

    def look(h: Column) -> Column:
        bare = F.when(h.endswith("-"), F.trim(F.regexp_replace(h, "-+$", "")))
        return F.when(h != "", F.coalesce(exact(h), exact(bare), partial(h), partial(bare)))

    return let(F.lower(F.trim(blank(c))), look)


def default_unit(entity: Column) -> Column:
    return ladder([(entity == k, F.lit(v)) for k, v in L.DEFAULT_UNITS.items()], F.lit(None))


def _hertz(value: str, unit: str) -> float:
    return float(value.replace(",", ".")) * L.FREQUENCY_FACTORS[unit.lower()]


def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.I)


_RANGE, _SINGLE, _FIELD, _EMISSION, _TOLERANCE, _KV, _V, _TERM, _CLASS = map(
    _compiled, (L.FACT_RANGE, L.FACT_FREQUENCY, L.FACT_FIELD, L.FACT_EMISSION, L.FACT_TOLERANCE, L.FACT_KILOVOLT, L.FACT_VOLT, L.FACT_TERM, L.FACT_CLASS)
)


def cell_facts(text: str | None, column: str | None = "") -> list[dict]:
    """The facts of a cell, kind after kind; a plainer kind passes over what a
    finer one has taken."""
    text, column = text or "", (column or "").lower()
    out: list[dict] = []

    def fact(kind: str, name: str, value: str, unit: str, raw: str, sure: float) -> None:
        out.append({"fact_type": kind, "name": name, "value": value, "unit": unit, "raw_value": raw, "confidence": sure})

    def fresh(pattern: re.Pattern[str]) -> Iterator[re.Match[str]]:
        return (m for m in pattern.finditer(text) if not any(m[0] in f["raw_value"] for f in out))

    dot: Callable[[str], str] = lambda s: s.replace(",", ".")
    for m in _RANGE.finditer(text):
        fact("frequency_range", "frequency_range", f"{_hertz(m[1], m[2])}-{_hertz(m[3], m[4])}", "Hz", m[0], 0.95)
    if not out or "frequency" not in column:
        for m in fresh(_SINGLE):
            fact("frequency_range", "frequency", str(_hertz(m[1], m[2])), "Hz", m[0], 0.85)
    for m in _FIELD.finditer(text):
        fact("field_strength", "field_strength", dot(m[1]), m[2], m[0], 0.95)
    for m in _EMISSION.finditer(text):
        fact("emission_limit", "emission_limit", dot(m[1]), L.EMISSION_UNITS.get((m[2] or "dbuv").lower(), m[2]), m[0], 0.95)
    for m in _TOLERANCE.finditer(text):
        value = dot(m[1].replace(" ", ""))
        if re.fullmatch(r"\d+(\.\d+)?", value):
            fact("field_strength", "voltage_level", value, m[2], m[0], 0.88)
    for m in _KV.finditer(text):
        fact("field_strength", "voltage_level", dot(m[1]), m[2], m[0], 0.92)
    if any(k in column for k in L.VOLTAGE_COLUMNS):
        for m in fresh(_V):
            fact("field_strength", "voltage_level", dot(m[1]), m[2], m[0], 0.85)
    if m := _TERM.search(text):
        term = m[0].lower().strip()
        fact("normative_term", "normative_term", term, STRENGTHS.get(term, "unknown"), m[0], 0.90)
    for m in _CLASS.finditer(text):
        fact("acceptance_criterion", "acceptance_class", f"class_{m[1].lower()}", "", m[0], 0.88)
    return out


@F.pandas_udf(FACT_TYPE)
def _facts(text: pd.Series, column: pd.Series) -> pd.Series:
    return pd.Series([cell_facts(t, c) for t, c in zip(text, column, strict=True)])


def facts(text: Column, column: Column) -> Column:
    return _facts(text, column)
