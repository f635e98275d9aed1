"""What clauses mean and how two versions differ, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseforge.functions import lexicon as L
from clauseforge.functions import text as T


def _find(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iU){pattern}")


def ladder(cases: list[tuple[Column, Column | str]], otherwise: Column | str | None = "") -> Column:
    """The value of the first case that holds."""
    out = F
    for test, value in cases:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def trim_phrase(c: Column) -> Column:
    t = F.regexp_replace(c, r"^[ ,;:.]+|[ ,;:.]+$", "")
    return F.trim(F.regexp_replace(t, r"(?U)^(all|the|a|an)\s+", ""))


def lemma(c: Column) -> Column:
    def cut(w: Column) -> Column:
        n = F.length(w)
        to = lambda k: F.substring(w, F.lit(1), n - k)
        return (
            F.when(w.endswith("ied") & (n > 4), F.concat(to(3), F.lit("y")))
            .when(w.endswith("ing") & (n > 5), to(3))
            .when(w.endswith("ed") & (n > 4), to(2))
            .when(w.endswith("es") & (n > 4), to(2))
            .when(w.endswith("s") & (n > 3), to(1))
            .otherwise(w)
        )

    return T.let(c, cut)


def clause_meaning(clean: Column) -> Column:
    """struct(obligation, subject, action, object, condition) of policy text: split
    at the first condition word; the earliest obligation wins, of equal positions
    the first in the list."""
    word = lambda c: F.regexp_extract(c, r"(?U)^(\S+)", 1)
    rest = lambda c: F.regexp_extract(c, r"(?Us)^\S+\s+(.*)$", 1)

    def split(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(r"(?iU)\b(" + "|".join(L.CONDITIONS) + r")\b"))
        cut = lambda n: F.struct(
            F.when(n > 0, trim_phrase(F.substring(t, F.lit(1), n - 1))).otherwise(t).alias("statement"),
            F.when(n > 0, trim_phrase(F.substring(t, n, F.length(t)))).otherwise("").alias("condition"),
        )
        return T.let(at, cut)

    def earliest(t: Column) -> Column:
        """Of an alternation the earliest match is found, of equal positions the first listed."""
        some = "(?iU)(" + "|".join(p for _, p in L.OBLIGATIONS) + ")"
        label = lambda w: ladder([(_find(w, f"^(?:{p})$"), name) for name, p in L.OBLIGATIONS], None)
        told = lambda w: F.when(w != "", F.struct(F.regexp_instr(t, F.lit(some)).alias("at"), label(F.trim(w)).alias("label"), F.length(w).alias("size")))
        return T.let(F.regexp_extract(t, some, 1), told)

    def act(predicate: Column) -> Column:
        auxiliary = word(predicate).isin("be", "is", "are") & (rest(predicate) != "")
        inner = F.when(auxiliary, rest(predicate)).otherwise(predicate)
        return T.let(inner, lambda x: F.struct(lemma(word(x)).alias("action"), trim_phrase(rest(x)).alias("object")))

    def assemble(s: Column, first: Column) -> Column:
        t = s["statement"]
        known = first.isNotNull()
        before = trim_phrase(F.substring(t, F.lit(1), first["at"] - 1))
        done = act(trim_phrase(F.substring(t, first["at"] + first["size"], F.length(t))))

        def fill(x: Column) -> Column:
            lends = (x["before"] == "") & x["done"]["object"].startswith("for ")
            obj = x["done"]["object"]
            return F.struct(
                F.when(known, first["label"]).otherwise("").alias("obligation"),
                F.when(~known, trim_phrase(t)).when(lends, trim_phrase(F.substring(obj, F.lit(5), F.length(obj)))).otherwise(x["before"]).alias("subject"),
                F.when(known, x["done"]["action"]).otherwise("").alias("action"),
                F.when(~known | lends, "").otherwise(obj).alias("object"),
                s["condition"].alias("condition"),
            )

        return T.let(F.struct(before.alias("before"), done.alias("done")), fill)

    return T.let(clean, lambda t: T.let(split(t), lambda s: T.let(earliest(s["statement"]), lambda f: assemble(s, f))))


def signature(meaning: Column) -> Column:
    parts = F.array(*[meaning[x] for x in ("subject", "action", "object", "condition")])
    return F.array_join(F.filter(parts, lambda x: x != ""), " | ")


def obligation_rank(c: Column) -> Column:
    return T.let(F.lower(T.blank(c)), lambda x: ladder([(x == k, F.lit(v)) for k, v in L.OBLIGATION_STRENGTH.items()], F.lit(-1)))


def obligation_change(left: Column, right: Column) -> Column:
    negated = lambda c: F.lower(T.blank(c)).endswith("_not")
    tell = lambda a, b: (
        F.when((negated(left) != negated(right)) & (a >= 0) & (b >= 0), "inverted")
        .when(a == b, "unchanged")
        .when(a < 0, "added")
        .when(b < 0, "removed")
        .when(b > a, "strengthened")
        .otherwise("weakened")
    )
    return T.let(obligation_rank(left), lambda a: T.let(obligation_rank(right), lambda b: tell(a, b)))


def meaning_score(left: Column, right: Column) -> Column:
    """Mean token overlap of the slots that either side has; 0 if none."""
    return T.let(left, lambda a: T.let(right, lambda b: _slots(a, b)))


def _slots(left: Column, right: Column) -> Column:
    both, n = [], []
    for slot in ("subject", "action", "object", "condition"):
        a, b = left[slot], right[slot]
        there = (a != "") | (b != "")
        overlap = T.jaccard(T.tokens(a, cleaned=True), T.tokens(b, cleaned=True))
        if slot == "action":
            overlap = F.when((a != "") & (a == b), 1.0).otherwise(overlap)
        both.append(F.when(there, overlap).otherwise(0.0))
        n.append(there.cast("int"))
    total, count = reduce(lambda x, y: x + y, both), reduce(lambda x, y: x + y, n)
    return F.when(count > 0, total / count).otherwise(0.0)


def requirement_verb(c: Column) -> Column:
    return T.let(F.lower(T.blank(c)), lambda t: ladder([(_find(t, p), v) for p, v in L.VERBS]))


def verb_strength(c: Column) -> Column:
    return ladder([(c == k, F.lit(v)) for k, v in L.VERB_STRENGTH.items()], F.lit(0))


def verb_direction(left: Column, right: Column) -> Column:
    """Null where the requirement verb is the same."""
    tell = lambda a, b: F.when(b > a, "strengthened").when(b < a, "weakened").otherwise("changed")
    return F.when(left != right, T.let(verb_strength(left), lambda a: T.let(verb_strength(right), lambda b: tell(a, b))))


def numbers(c: Column) -> Column:
    found = F.regexp_extract_all(T.blank(c), F.lit(f"(?iU)({L.NUMBER})"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(F.trim(x)), r"(?U)\s+", " "))))


def numeric_changes(left: Column, right: Column) -> Column:
    """Array of struct(type, old, new): what is only left and only right, both
    sorted and paired; the rest removed or added."""

    def pair(gone: Column, come: Column) -> Column:
        n = F.greatest(F.size(gone), F.size(come))
        return F.transform(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(
                F.when(i > F.size(come), "removed").when(i > F.size(gone), "added").otherwise("modified").alias("type"),
                F.get(gone, i - 1).alias("old"),
                F.get(come, i - 1).alias("new"),
            ),
        )

    only = lambda a, b: F.array_sort(F.array_except(a, b))
    return T.let(numbers(left), lambda a: T.let(numbers(right), lambda b: T.let(only(a, b), lambda x: T.let(only(b, a), lambda y: pair(x, y)))))


def same_numbers(left: Column, right: Column) -> Column:
    return numbers(left) == numbers(right)


def is_formatting_only(left: Column, right: Column) -> Column:
    a, b = F.trim(T.blank(left)), F.trim(T.blank(right))
    plain = lambda c: T.normalize(F.regexp_replace(c, r"[-–—\n\r;]", " "))
    return (a != "") & (b != "") & (a != b) & (plain(a) == plain(b))


def is_reference_only(left: Column, right: Column) -> Column:
    bare = lambda c: F.regexp_replace(T.blank(c), f"(?iU){L.REFERENCE}", "")
    return ~same_numbers(left, right) & same_numbers(bare(left), bare(right))


def is_cosmetic(left: Column, right: Column) -> Column:
    a, b = F.trim(T.blank(left)), F.trim(T.blank(right))
    nums = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)*)"))
    same = (T.cosmetic(a) == T.cosmetic(b)) | ((T.compact(a) == T.compact(b)) & (nums(a) == nums(b)))
    return (a != "") & (b != "") & (a != b) & same


def entity_type(context: Column) -> Column:
    """The domain entity a change is about, by priority; '' for none."""
    t = T.blank(context)
    return ladder(
        [
            (_find(t, L.FIELD_STRENGTH), "FieldStrength"),
            (_find(t, L.EMISSION_LIMIT), "EmissionLimit"),
            (_find(t, L.ACCEPTANCE_CLASS), "AcceptanceCriterion"),
            (_find(t, L.TEST_METHOD), "TestMethod"),
            (t.rlike(f"(?iUs){L.FREQUENCY_RANGE}"), "FrequencyRange"),
        ]
    )


def is_procedure_change(left: Column, right: Column) -> Column:
    methods = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(T.blank(c), F.lit(f"(?iU)({L.TEST_METHOD})"))))
    dwell = _find(T.blank(left), L.DWELL_TIME) | _find(T.blank(right), L.DWELL_TIME)
    return (methods(left) != methods(right)) | (dwell & ~same_numbers(left, right))


def is_setup_change(left: Column, right: Column) -> Column:
    told = _find(T.blank(left), L.TEST_SETUP) | _find(T.blank(right), L.TEST_SETUP)
    return told & ~same_numbers(left, right)


def importance(c: Column, chunk_type: Column) -> Column:
    """struct(score, level) of how much a chunk matters."""
    t = F.trim(T.blank(c))
    score = (
        F.when(chunk_type == "table", 0.5).otherwise(0.1)
        + F.when(_find(t, L.OBLIGATION_HINT) | (clause_meaning(T.policy_text(t, 0))["obligation"] != ""), 0.4).otherwise(0.0)
        + F.when(_find(t, L.DURATION_HINT) | _find(t, L.NUMBER_HINT), 0.15).otherwise(0.0)
        + F.when(_find(t, L.ROLE_HINT), 0.15).otherwise(0.0)
        + F.when(_find(t, L.REGULATION_HINT), 0.1).otherwise(0.0)
    )
    score = F.when(t == "", 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))
    return F.struct(score.alias("score"), F.when(score >= 0.65, "high").when(score >= 0.35, "medium").otherwise("low").alias("level"))


def is_caption_like(c: Column) -> Column:
    t = F.trim(T.blank(c))
    return (t != "") & (F.size(F.split(t, r"\s+")) <= 12) & _find(t, L.CAPTION_ONLY)


def is_skipped_section(c: Column) -> Column:
    return T.blank(c).rlike(f"(?iU){L.SKIPPED_SECTIONS}")


def test_type(c: Column) -> Column:
    """Signals may lie inside words, as in "category", which holds "ri"."""
    t = F.lower(T.blank(c))
    return ladder([(reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in signals]), name) for name, signals in L.TEST_TYPES], "unknown")


def hertz(value: Column, unit: Column) -> Column:
    v = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    factor = ladder([(F.lower(unit) == k, F.lit(x)) for k, x in L.FREQUENCY_FACTORS.items()], F.lit(1.0))
    return F.coalesce(v * factor, F.lit(0.0))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.blank(c), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_auxiliary(c: Column, section_title: Column) -> Column:
    """Empty, under a title of auxiliary matter, or a list of short lines with dot
    leaders and page numbers."""

    def listed(lines: Column) -> Column:
        count = lambda test: F.size(F.filter(lines, test))
        return (
            (F.size(lines) >= 6)
            & (F.size(F.regexp_extract_all(T.blank(c), F.lit(r"(\.{3,})"))) >= 3)
            & (count(lambda x: x.rlike(r"(?U)\s\d{1,4}\s*$")) >= 3)
            & (count(lambda x: F.length(x) <= 70) / F.greatest(F.size(lines), F.lit(1)) > 0.6)
        )

    return (F.trim(T.blank(c)) == "") | _find(T.blank(section_title), L.AUXILIARY_TITLES) | T.let(_lines(c), listed)


def contents_reason(c: Column, title: Column, section_titles: Column, labels: Column) -> Column:
    """Why a block is left out as a table of contents; null where it is none."""
    plain = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), T.normalize)
    named = T.normalize(title).isin(*L.CONTENTS_TITLES) | F.arrays_overlap(plain(section_titles), F.array(*map(F.lit, L.CONTENTS_TITLES)))

    def listed(lines: Column) -> Column:
        alike = F.size(F.filter(lines, lambda x: x.rlike(L.CONTENTS_LINE)))
        return (F.size(lines) >= 3) & (alike >= 3) & (alike / F.size(lines) >= 0.5)

    return (
        F.when(F.array_contains(plain(labels), "document_index"), "document_index")
        .when(named | T.let(_lines(c), listed), "table_of_contents")
    )
