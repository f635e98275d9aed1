"""Profiles of document families, and answers of models as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseforge.functions import lexicon as L
from clauseforge.functions.text import blank

_MEANING = "array<struct<obligation:string,subject:string,action:string,object:string,condition:string>>"


def family_profile(name: Column, headings: Column) -> Column:
    """The family of a document: by hints in its file name, else by two of the signal
    words in its headings; null without."""
    low = F.lower(blank(name))
    told = F.lower(F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " "))
    hits = F.size(F.filter(F.array(*map(F.lit, L.family_signal_words())), lambda w: F.contains(told, w)))
    cases = [F.when(F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, h)), family) for family, hints in L.FAMILY_HINTS.items()]
    return F.coalesce(*cases, F.when(hits >= 2, L.SIGNALLED_FAMILY))


def is_conservative(family: Column) -> Column:
    """Whether the family's candidate tables are taken as they are; null without a family."""
    return F.when(family.isNotNull(), family.isin(*L.CONSERVATIVE_FAMILIES))


def meaning_payload(answer: Column, expected: Column) -> Column:
    """The meanings in a model's answer, a JSON list or one with words around it, missing
    fields blank; null where it does not hold ``expected`` of them."""
    t = F.trim(blank(answer))
    inner = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    items = F.coalesce(F.from_json(F.when(t.startswith("["), t), _MEANING), F.from_json(F.when(inner != "", inner), _MEANING))
    fields = ("obligation", "subject", "action", "object", "condition")
    return F.when(F.size(items) == expected, F.transform(items, lambda x: F.struct(*[F.trim(blank(x[f])).alias(f) for f in fields])))
