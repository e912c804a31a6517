"""Which reading a witness has, and which a family has: the two shared choices of all metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Collation, written


def main_units(c: Collation) -> DataFrame:
    return c.units.filter(F.col("app_type") == c.settings.main_type)


def not_lacuna(c: Collation) -> Column:
    """Not a gap in the witness; readings without a type count."""
    return ~F.col("reading_type").eqNullSafe(c.settings.lacuna_type)


def folded(c: Collation) -> Column:
    """Readings that count as the base text: the lemma and orthographic sub-readings."""
    return F.coalesce(F.col("is_lemma"), F.lit(False)) | F.coalesce(F.col("reading_type") == c.settings.folded_type, F.lit(False))


def attested(c: Collation, with_base: bool = False, units: DataFrame | None = None) -> DataFrame:
    """(app_id, reading_id, reading_type, is_lemma, base_ga, hand) of main units, without lacunae.

    All joins are by unit, so the attestation is shuffled once, by unit, and what follows by unit needs no further
    shuffle: a unit has few readings, of which the attested one is taken in place (the two comparisons are an
    equality that isn't a key of the join, by which rows would be shuffled again).  ``units``: only those main units
    (app_id), which narrow the attestation before it is shuffled if they are to be broadcast.
    """
    seen = c.attestation.select("app_id", "reading_id", "base_ga", "hand")
    if not with_base:
        seen = seen.filter(F.col("base_ga") != c.settings.base_witness)
    readings = c.readings.select("app_id", F.col("reading_id").alias("_r"), "reading_type", "is_lemma").filter(not_lacuna(c))
    readings = readings.join(main_units(c).select("app_id") if units is None else units, "app_id", "left_semi")
    seen = seen if units is None else seen.join(units, "app_id", "left_semi")
    met = seen.join(readings, "app_id").filter((F.col("reading_id") <= F.col("_r")) & (F.col("reading_id") >= F.col("_r")))
    return met.select("app_id", "reading_id", "reading_type", "is_lemma", "base_ga", "hand")


def one_reading(c: Collation, policy: str = "fold", with_base: bool = False) -> DataFrame:
    """One reading of each witness in each unit: the first hand's, then

    fold: the base text before other readings, then by id (instability and consensus);
    raw: by id (family vote and genealogy).
    """
    if c.chosen is not None:
        rows = c.chosen if with_base else c.chosen.filter(F.col("base_ga") != c.settings.base_witness)
        return rows.select("app_id", f"{policy}.reading_id", f"{policy}.reading_type", f"{policy}.is_lemma", "base_ga")
    first = F.when(F.col("hand") == "firsthand", 0).otherwise(1)
    keys = {"fold": [first, F.when(folded(c), 0).otherwise(1), F.col("reading_id")], "raw": [first, F.col("reading_id")]}[policy]
    nth = F.row_number().over(Window.partitionBy("app_id", "base_ga").orderBy(*keys))
    return attested(c, with_base).withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "hand")


def settled(c: Collation) -> Collation:
    """The collation with its chosen readings by both policies written once (in an order by unit, so counts by unit
    leave each task small), for plans that use them several times."""
    if c.chosen is not None:
        return c
    first, base = F.when(F.col("hand") == "firsthand", 0).otherwise(1), F.when(folded(c), 0).otherwise(1)
    own = ["reading_id", "reading_type", "is_lemma"]
    rows = attested(c, with_base=True).groupBy("app_id", "base_ga").agg(
        F.min(F.struct(first.alias("_a"), base.alias("_b"), *own)).alias("fold"), F.min(F.struct(first.alias("_a"), *own)).alias("raw")
    )
    take = lambda p: F.struct(*[F.col(f"{p}.{n}") for n in own]).alias(p)
    rows = rows.join(main_units(c).select("app_id", "verse_id"), "app_id").select("app_id", "verse_id", "base_ga", take("fold"), take("raw"))
    return replace(c, chosen=written(rows, "settled"))


def extant(c: Collation) -> DataFrame:
    """(verse_id, base_ga): the witnesses of each main unit, by its verse."""
    if c.chosen is not None:
        return c.chosen.filter(F.col("base_ga") != c.settings.base_witness).select("verse_id", "base_ga")
    return attested(c).select("app_id", "base_ga").join(main_units(c).select("app_id", "verse_id"), "app_id").select("verse_id", "base_ga")


def group(c: Collation) -> Column:
    """What is compared in consensus: 'base' for folded readings, else the reading."""
    return F.when(folded(c), F.lit("base")).otherwise(F.col("reading_id"))


def plurality(rows: DataFrame, keys: list[str], choice: str, *carried: Column) -> DataFrame:
    """The most frequent ``choice`` of each group, the least one on a tie, with its count n."""
    counts = rows.groupBy(*keys, choice).agg(F.count("*").alias("n"), *carried)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), choice))
    return counts.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def labelled(c: Collation, rows: DataFrame) -> DataFrame:
    """Rows of witnesses with a family, and the family."""
    return rows.join(c.known.filter(F.col("family").isNotNull()), "base_ga")


def with_family(c: Collation, rows: DataFrame, missing: str = "other") -> DataFrame:
    """All rows with their witness's family; witnesses without one count as ``missing``."""
    return rows.join(c.known, "base_ga", "left").withColumn("family", F.coalesce("family", F.lit(missing)))
