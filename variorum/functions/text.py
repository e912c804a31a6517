"""Scalar functions of the collation as Column expressions: identifiers, dates, sections, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pericopes with Synoptic parallels (chapter, first verse, last verse).
SYNOPTIC_RANGES = [(1, 19, 34), (2, 13, 22), (6, 1, 21), (12, 1, 8), (12, 12, 19), (13, 21, 30), (18, 1, 40), (19, 1, 42)]

# Roman signs, what a smaller sign before a larger one takes away twice, and the canonical form.
_ROMAN_SIGNS = [("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1)]
_ROMAN_LESS = [("C[MD]", 200), ("X[CL]", 20), ("I[XV]", 2)]
_ROMAN_FORM = r"^(?=.)M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_verse_id(verse_id: str | Column) -> Column:
    """struct(book, chapter, verse) of ids like B04K1V1; ('', -1, -1) for anything else."""
    v = F.coalesce(col(verse_id), F.lit(""))
    pattern = r"^(B\d+)K(\d+)V(\d+)"
    found = F.rlike(v, F.lit(pattern))
    number = lambda k: F.when(found, F.regexp_extract(v, pattern, k).cast("int")).otherwise(-1)
    return F.struct(F.when(found, F.regexp_extract(v, pattern, 1)).otherwise("").alias("book"), number(2).alias("chapter"), number(3).alias("verse"))


def siglum_base(siglum: str | Column) -> Column:
    """The manuscript a siglum belongs to: its leading number (with P or L), else the whole siglum."""
    s = F.trim(col(siglum))
    return F.coalesce(F.nullif(F.regexp_extract(s, r"^(P\d+|L\d+|\d+)", 1), F.lit("")), s)


def siglum_hand(siglum: str | Column) -> Column:
    """firsthand, corrector, lection, instance or other, by what follows the base; in this order."""
    s = F.trim(col(siglum))
    base = siglum_base(s)
    rest = F.substring(s, F.length(base) + 1, F.length(s))
    return (
        F.when(rest.isin("", "*", "V"), "firsthand")
        .when(F.contains(rest, F.lit("C")) | F.startswith(rest, F.lit("S")) | F.startswith(rest, F.lit("Z")) | F.contains(F.lower(rest), F.lit("corr")), "corrector")
        .when(F.startswith(base, F.lit("L")), "lection")
        .when(F.contains(rest, F.lit("-")), "instance")
        .otherwise("other")
    )


def words(text: str | Column) -> Column:
    """The blank-separated parts of a text, without empty ones."""
    return F.filter(F.split(col(text), r"\s+"), lambda x: x != "")


def collapse(text: str | Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def ga_to_docid(siglum: str | Column) -> Column:
    """The catalogue number of a siglum: papyri, majuscules (leading 0), minuscules, lectionaries."""
    s = col(siglum)
    number = lambda n: F.substring(s, F.lit(n), F.length(s))
    plain = lambda n, start: F.try_add(F.lit(start), F.when(F.rlike(number(n), F.lit(r"^\d+$")), number(n).try_cast("int")))
    return (
        F.when(F.startswith(s, F.lit("P")), plain(2, 10000)).when(F.startswith(s, F.lit("L")), plain(2, 40000)).when(F.startswith(s, F.lit("0")), plain(1, 20000)).otherwise(plain(1, 30000))
    )


def century(numeral: str | Column) -> Column:
    """The number of a canonical Roman numeral (any case), else null."""
    s = F.upper(F.trim(col(numeral)))
    total = F.lit(0).cast("long")
    for sign, value in _ROMAN_SIGNS:
        total = total + (F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))).cast("long") * value
    for pattern, value in _ROMAN_LESS:
        total = total - F.when(F.rlike(s, F.lit(pattern)), value).otherwise(0)
    return F.when(F.rlike(s, F.lit(_ROMAN_FORM)), total.try_cast("int"))


def parse_orig(orig: str | Column) -> Column:
    """struct(date_early, date_late) in years: a year, a century in Roman numerals, or several."""
    s = F.trim(F.regexp_replace(col(orig), r"\(.*?\)", ""))
    year = F.regexp_extract(s, r"^(\d{3,4})(?:\.0)?$", 1)
    is_year = year != ""
    found = F.filter(F.transform(F.split(s, "/"), lambda x: century(x)), lambda x: x.isNotNull())
    found = F.when(F.size(found) > 0, found)
    early = F.when(is_year, year.try_cast("int")).otherwise((F.array_min(found).cast("long") - 1) * 100)
    late = F.when(is_year, year.try_cast("int")).otherwise(F.array_max(found).cast("long") * 100 - 1)
    return F.struct(early.try_cast("int").alias("date_early"), late.try_cast("int").alias("date_late"))


def midpoint(early: str | Column, late: str | Column) -> Column:
    return F.floor((col(early) + col(late)) / 2).cast("int")


def section(chapter: str | Column, verse: str | Column) -> Column:
    """prologue, farewell, appendix or body."""
    c, v = col(chapter), col(verse)
    return F.when((c == 1) & (v <= 18), "prologue").when(c.between(13, 17), "farewell").when(c == 21, "appendix").otherwise("body")


def is_synoptic(chapter: str | Column, verse: str | Column, ranges: Sequence[tuple[int, int, int]] = tuple(SYNOPTIC_RANGES)) -> Column:
    out = F.lit(False)
    for c, low, high in ranges:
        out = out | ((col(chapter) == c) & col(verse).between(low, high))
    return out


def word_place(offset: str | Column) -> Column:
    """struct(kind, index) of an even (word) or odd (gap) offset."""
    o = col(offset)
    return F.struct(F.when(F.pmod(o, F.lit(2)) == 1, "gap").otherwise("word").alias("kind"), F.floor(o / 2).cast("int").alias("index"))


def reference(title: str, chapter: str | Column, verse: str | Column) -> Column:
    return F.format_string(f"{title} %s:%s", col(chapter), col(verse))


def link(template: str | Column, siglum: str | Column, available: Column) -> Column:
    """The template with the siglum for ``{ga}``, where it is available."""
    return F.when(available, F.replace(col(template), F.lit("{ga}"), col(siglum)))


def binary_round(value: str | Column, digits: int) -> Column:
    """Rounding to at most four digits by the exact binary value, halves to even (Spark's ``round`` takes the
    shortest decimal form and goes up).

    A double is m * 2**e with a whole m below 2**53, so m * 5**digits is exact in 64 bits and the rest is a shift."""
    if not 0 <= digits <= 4:
        raise ValueError("0 to 4 digits")
    x = col(value).cast("double")
    size = F.abs(x)
    e = F.floor(F.log2(size)).cast("int") - 52
    e = F.when(size * F.pow(F.lit(2.0), -e) >= 2.0**53, e + 1).when(size * F.pow(F.lit(2.0), -e) < 2.0**52, e - 1).otherwise(e)
    scaled = (size * F.pow(F.lit(2.0), -e)).cast("long") * F.lit(5**digits).cast("long")
    down = -(e + digits)  # value * 10**digits = scaled / 2**down
    whole = F.call_function("shiftright", scaled, down)
    rest = scaled - F.call_function("shiftleft", whole, down)
    half = F.call_function("shiftleft", F.lit(1).cast("long"), down - 1)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    exact = (whole + up.cast("long")).cast("double") / F.lit(float(10**digits)) * F.signum(x)
    # numbers of 2**44 and more are too large for the product; beyond 63 bits of a rest the half is never reached
    return F.when(x.isNull() | F.isnan(x), x).when(size >= 2.0**44, F.round(x, digits)).when((size == 0) | (down > 63), 0.0).otherwise(exact)


def weight_tier(split: Column, instability: Column, n_variant_wit: Column) -> Column:
    """How far a variation reaches: branch, tradition, singular or subfamily."""
    return F.when(split, "branch").when(instability > 0, "tradition").when(n_variant_wit <= 1, "singular").otherwise("subfamily")


def low_confidence(n_early: Column, n_families: Column, eff_families: Column, s) -> Column:
    return (n_early <= s.low_confidence_max_early) | (n_families < s.low_confidence_min_families) | (eff_families < s.low_confidence_min_eff_families)
