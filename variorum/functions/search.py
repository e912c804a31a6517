"""What a reader asks for: addresses of views, jumps to a verse, filters of lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: The views of the site by the address they have.
VIEWS = ("verses", "families", "about")


def jump(query: str | Column, book: str = "B04", chapters: int = 21) -> Column:
    """The address that a typed query leads to: 3:16, 3.16 or 3 16 a verse, 3 a chapter; null for anything else."""
    q = F.trim(col(query))
    verse = r"^([0-9]{1,2})(?:\s*[:.]\s*|\s+)([0-9]{1,3})$"
    number = lambda pattern, k: F.nullif(F.regexp_extract(q, pattern, k), F.lit("")).cast("int")
    chapter = number(r"^([0-9]{1,2})$", 1)
    return F.when(F.rlike(q, F.lit(verse)), F.concat(F.lit(f"verse/{book}K"), number(verse, 1).cast("string"), F.lit("V"), number(verse, 2).cast("string"))).when(
        chapter.between(1, chapters), F.concat(F.lit("chapter/"), chapter.cast("string"))
    )


def route(address: str | Column) -> Column:
    """struct(view, key) of a page address (#/verse/ID, #/chapter/N, #/verses, ...); unknown ones lead to the overview."""
    h = F.regexp_replace(F.coalesce(col(address), F.lit("")), r"^#?/?", "")
    parts = F.split(h, "/")
    head, key = F.get(parts, F.lit(0)), F.nullif(F.get(parts, F.lit(1)), F.lit(""))
    keyed = head.isin("chapter", "verse") & F.contains(h, F.lit("/"))
    view = F.when(keyed, head).when(h.isin(*VIEWS), h).otherwise("overview")
    return F.struct(view.alias("view"), F.when(keyed, key).alias("key"))


def matches(query: str | Column, *fields: str | Column) -> Column:
    """Whether a filter's text occurs in the fields, in either case; an empty filter takes all."""
    q = F.lower(F.trim(F.coalesce(col(query), F.lit(""))))
    return F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(col(f), F.lit("")) for f in fields])), q)


def ramp(value: str | Column, low: Column, high: Column) -> Column:
    """The place of a value on a colour scale: 0 to 1, clamped; 0 where the scale has no width."""
    v = col(value)
    at = (v - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(at > 1.0, 1.0).when(at > 0.0, at).otherwise(F.when(v.isNotNull(), 0.0))
