"""Text functions as Column expressions.  Null texts count as empty."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseforge.functions import lexicon as L

UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(blank(c), r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    return F.lower(collapse(c))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC; the Python step runs only on rows that need it, as plain ASCII is
    its own normal form."""
    plain = c.rlike(r"^\p{ASCII}*$")
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


def comparable(c: Column, unicode: bool = True) -> Column:
    """The form in which two texts are compared: NFKC (with ``unicode``), joined
    line-end hyphens, one space, units next to digits, plain bullets, spaces for
    inner hyphens, regular spacing after punctuation, lower case."""
    t = F.regexp_replace(F.regexp_replace(blank(c), r"(?U)^\s+|\s+$", ""), r"[\\/]+$", "")
    t = F.regexp_replace(F.replace(t, F.lit("­"), F.lit("")), r"\r\n?", "\n")
    t = nfkc(t) if unicode else t
    steps = (
        (r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"),
        (r"(?U)\s+", " "),
        (r"(?U)(\d)\s+([a-zA-Z])(?!\w{3,})", "$1$2"),
        (r"(?U)^\s*([•●▪◦\-–—*]|[\(\[]?\d+[\)\].:]|[A-Za-z]\))\s+", "- "),
        (r"(?U)(?<=\w)-(?=\w)", " "),
        (r"(?U)\s*([;,])\s*", "$1 "),
        (r"(?U)\s*:\s*", ": "),
    )
    return F.trim(F.lower(reduce(lambda x, s: F.regexp_replace(x, *s), steps, t)))


def pure_hash(c: Column) -> Column:
    """SHA-256 of the lower-case letters and digits; '' without any."""
    kept = F.regexp_replace(F.lower(blank(c)), r"[^\p{L}\p{N}]", "")
    return F.when(kept == "", "").otherwise(F.sha2(kept, 256))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(c), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def uuid5_url(c: Column) -> Column:
    """uuid5 in the URL namespace: SHA-1 with the version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(UUID_URL_NAMESPACE)), c.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def policy_text(c: Column, upto: int | None = None) -> Column:
    """Policy text without citations, markers and leaders, synonyms unified."""
    t = F.translate(collapse(c), "“”‘’–—", "\"\"''--")
    t = F.replace(t, F.lit("…"), F.lit("..."))
    steps = [
        (r"(?U)(?<!\w)\[\d+\](?!\w)", " "),
        (r"(?iU)(?<!\w)\((?:[a-z]|\d+|[ivxlcdm]+)\)(?!\w)", " "),
        (r"(?iU)^\s*(?:(?:section|clause|article|appendix|annex)\s+)?[a-z]?\d+(?:\.\d+)*[a-z]?(?:[.):]|\s)\s*", ""),
        (r"[.]{3,}", " "),
        (r"[-_=]{3,}", " "),
    ]
    plain = reduce(lambda x, s: F.regexp_replace(x, *s), steps, t)
    synonyms = L.SYNONYMS[:upto]
    if not synonyms:
        return normalize(plain)
    some = "(?iU)" + "|".join(p for p, _ in synonyms)  # most texts have none, which one search tells
    unify = lambda x: reduce(lambda y, s: F.regexp_replace(y, f"(?iU){s[0]}", s[1]), synonyms, x)
    return normalize(let(plain, lambda x: F.when(x.rlike(some), unify(x)).otherwise(x)))


def stopwords(language: str = "") -> list[str]:
    names = [language] if language in L.STOPWORDS else list(L.STOPWORDS)
    return list(dict.fromkeys(w for n in names for w in L.STOPWORDS[n].split()))


def tokens(c: Column, language: str = "", cleaned: bool = False) -> Column:
    """Tokens of policy text (``cleaned``: c is policy text already)."""
    found = F.regexp_extract_all(c if cleaned else policy_text(c), F.lit("([a-z0-9]+)"))
    stop = F.array(*[F.lit(w) for w in stopwords(language)])
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1."""
    sizes = let(a, lambda x: let(b, lambda y: F.struct(F.size(F.array_intersect(x, y)).alias("both"), F.size(F.array_union(x, y)).alias("whole"))))
    return let(sizes, lambda n: F.when(n["whole"] == 0, 1.0).otherwise(n["both"] / n["whole"]))


def is_noise(c: Column) -> Column:
    return let(collapse(c), lambda t: (F.length(t) < 5) | t.rlike(r"(?U)^[\d\W_]+$"))


def is_trivial(c: Column) -> Column:
    """No more than a number, page, version or bare section label."""

    def test(t: Column) -> Column:
        digits = F.length(F.regexp_replace(t, r"(?U)\D", ""))
        return (
            (F.length(t) <= 7)
            | t.rlike(r"(?U)^[\d\s.\-/,;:()\[\]]+$")
            | t.rlike(r"(?iU)^\s*(?:page|p\.?|pg\.?|seite|s\.?)\s*\d+\s*(?:of|von|de|sur)?\s*\d*\s*$")
            | t.rlike(r"(?iU)^v?\d+(?:\.\d+){1,3}$")
            | t.rlike(r"(?iU)^\s*(?:section|article|clause|annex|appendix|chapter|part)\s+[A-Z]?[\d.]+\s*$")
            | ((F.length(t) <= 20) & (digits / F.length(t) > 0.65))
        )

    return let(collapse(c), test)


def is_orphan(c: Column, node_type: Column) -> Column:
    """An extraction leftover: no table, heading or obligation, and short, a figure
    caption, a running header or the end of a split word."""
    t = collapse(c)
    title = t.rlike(r"(?U)^[^\p{L}]*(\p{Lu}\p{Ll}*[^\p{L}]+)*(\p{Lu}\p{Ll}*)[^\p{L}]*$")
    odd = (
        (F.length(t) < 25)
        | t.rlike(f"(?iU){L.FIGURE_CAPTION}")
        | ((F.length(t) <= 45) & ((t == F.upper(t)) | title))
        | ((F.length(t) < 30) & t.rlike(r"^\p{Ll}"))
    )
    return (t != "") & ~blank(node_type).isin("heading", "table") & ~t.rlike(f"(?iU){L.ORPHAN_OBLIGATION}") & odd


def ends_sentence(c: Column) -> Column:
    return F.rtrim(blank(c)).rlike(r"[.!?:;]$")


def starts_lower(c: Column) -> Column:
    return blank(c).rlike(r"^[^\p{L}]*\p{Ll}")


def cosmetic(c: Column) -> Column:
    """Letters and digits in lower case, camel case and punctuation to spaces."""
    t = F.regexp_replace(blank(c), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.trim(F.regexp_replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(blank(c)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def mask_pii(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, f"(?iU){p[0]}", p[1]), L.PII, c)


def short(c: Column, most: int = 90) -> Column:
    t = collapse(c)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit("..."))).otherwise(t)


def human_size(n: Column) -> Column:
    kb, mb = F.bround(n / 1024, 1), F.bround(n / (1024 * 1024), 1)  # halves to even, as C's formats
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def is_header_footer(c: Column) -> Column:
    t = F.trim(blank(c))
    told = reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(x)) for x in L.CONFIDENTIALITY])
    return (t != "") & (F.length(t) <= 200) & (t.rlike(f"(?iU){L.PAGE_NUMBER}") | told)


def family(filename: Column) -> Column:
    """A document's family: its file name without extension and version, as a slug."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(blank(filename), r"^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    plain = F.trim(F.regexp_replace(stem, r"(?i)(?:[-_ ](?:v(?:ersion)?[-_ ]?)?\d+(?:\.\d+)*)$", ""))
    named = slug(F.when(plain == "", stem).otherwise(plain))
    return F.when(named == "", "document").otherwise(named)


def anchor(c: Column) -> Column:
    """A clause's marker, or its first twelve words."""
    marker = F.regexp_extract(blank(c), r"(?i)^\s*((?:section|clause|article|appendix|annex)?\s*[A-Za-z]?\d+(?:\.\d+)*[A-Za-z]?)\b", 1)
    return F.when(marker != "", normalize(marker)).otherwise(F.array_join(F.slice(F.split(normalize(c), " "), 1, 12), " "))


def without_thoughts(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"(?s)<think>.*?(?:</think>|$)", "")


def german_number(c: Column) -> Column:
    t = F.regexp_replace(blank(c), r"\s+", "")
    t = F.when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
