"""Metrics of a collation by unit, verse and chapter.

Every metric is one declarative plan.  Facts are narrowed to the needed columns before they are
joined, counts are conditional aggregates in one pass instead of joins of several, and dimension
tables are left for Spark to broadcast where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.choose import attested, extant, folded, group, labelled, main_units, not_lacuna, one_reading, plurality, settled, with_family
from ..operators.statistics import average_rank, z_scores
from ..schema import Collation, bounded, written

FAMILIES = ("Alexandrian", "Byz", "f1", "f13", "other")


def _substantive(c: Collation) -> Column:
    return F.col("reading_type").isNull() | F.col("reading_type").isin(*c.settings.omission_types)


# ---- instability ---------------------------------------------------------------------------------


def substantive_readings(c: Collation) -> DataFrame:
    """(app_id, n_subst_readings) of all main units: readings without a type, and omissions."""
    counts = c.readings.groupBy("app_id").agg(F.count_if(_substantive(c)).alias("n"))
    return main_units(c).select("app_id").join(counts, "app_id", "left").select("app_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_subst_readings"))


def unit_instability(c: Collation) -> DataFrame:
    """Share of the extant witnesses that depart from the base text, for every main unit."""
    lemma = F.coalesce(F.col("is_lemma"), F.lit(False))
    counts = one_reading(c, "fold").groupBy("app_id").agg(
        F.count("*").alias("n_extant"), F.count_if(folded(c)).alias("n_lemma"), F.count_if(~lemma & _substantive(c)).alias("n_diverge")
    )
    units = main_units(c).select("app_id", "verse_id", "chapter", "verse")
    zero = F.lit(0).cast("long")
    out = units.join(counts, "app_id", "left").join(substantive_readings(c), "app_id", "left")
    return out.select(
        *units.columns, *[F.coalesce(n, zero).alias(n) for n in ("n_extant", "n_lemma", "n_diverge", "n_subst_readings")],
        (F.col("n_diverge") / F.nullif(F.col("n_extant"), zero)).alias("instability"),
    )


def verse_coverage(c: Collation) -> DataFrame:
    """(verse_id, extant_base_ms): distinct witnesses of a verse's main units."""
    seen = extant(c)
    return seen.groupBy("verse_id").agg(F.countDistinct("base_ga").alias("extant_base_ms"))


def verse_metrics(c: Collation, units: DataFrame | None = None) -> DataFrame:
    units = unit_instability(c) if units is None else units
    by = units.groupBy("chapter", "verse", "verse_id").agg(
        F.count("*").alias("n_units"), F.avg("instability").alias("instability"), F.sum("n_diverge").alias("n_diverge_sum"), F.avg("n_extant").alias("n_extant_mean")
    )
    return by.join(verse_coverage(c), "verse_id", "left").select("chapter", "verse", "verse_id", "n_units", "instability", "n_diverge_sum", "n_extant_mean", "extant_base_ms")


def chapter_metrics(c: Collation, verses: DataFrame | None = None) -> DataFrame:
    """Means over verses (of means over units)."""
    verses = verse_metrics(c) if verses is None else verses
    return verses.groupBy("chapter").agg(
        F.count("*").alias("n_verses"), F.sum("n_units").alias("n_units"), F.avg("instability").alias("instability"), F.avg("extant_base_ms").alias("coverage_mean")
    )


# ---- consensus and stability ----------------------------------------------------------------------


def unit_consensus(c: Collation) -> DataFrame:
    """Share of the extant witnesses on the most common reading; units that nobody attests have no row."""
    counts = one_reading(c, "fold").withColumn("grp", group(c)).groupBy("app_id", "grp").agg(F.count("*").alias("n"))
    # the largest count and how many readings have it: from the sorted counts of a unit's few readings
    each = counts.groupBy("app_id").agg(F.sum("n").alias("extant"), F.max("n").alias("top"), F.collect_list("n").alias("ns"))
    each = each.withColumn("tied", F.size(F.filter("ns", lambda n: n == F.col("top"))) > 1)
    units = main_units(c).select("app_id", "chapter", "verse", "verse_id")
    return units.join(each, "app_id").select(*units.columns, (F.col("top") / F.nullif(F.col("extant"), F.lit(0).cast("long"))).alias("consensus"), "extant", "tied")


def family_consensus(c: Collation) -> DataFrame:
    """Share of the families on the most common family reading; null where fewer than two families are extant."""
    rows = labelled(c, one_reading(c, "fold")).withColumn("grp", group(c)).select("app_id", "family", "grp")
    votes = plurality(rows, ["app_id", "family"], "grp").groupBy("app_id", "grp").agg(F.count("*").alias("n"))
    each = votes.groupBy("app_id").agg(F.sum("n").alias("n_fam"), F.max("n").alias("top"))
    units = main_units(c).select("app_id", "verse_id")
    return units.join(each, "app_id").select("app_id", "verse_id", "n_fam", F.when(F.col("n_fam") >= 2, F.col("top") / F.nullif(F.col("n_fam"), F.lit(0).cast("long"))).alias("family_consensus"))


def unit_stability(c: Collation) -> DataFrame:
    """Both consensus metrics with anchors; a missing value is no anchor."""
    at = c.settings.anchor_at
    out = unit_consensus(c).join(family_consensus(c).drop("verse_id"), "app_id", "left")
    return out.withColumn("is_anchor", F.coalesce(F.col("consensus") >= at, F.lit(False))).withColumn("is_family_anchor", F.coalesce(F.col("family_consensus") >= at, F.lit(False)))


def verse_stability(c: Collation, units: DataFrame | None = None) -> DataFrame:
    units = unit_stability(c) if units is None else units
    return units.groupBy("chapter", "verse", "verse_id").agg(
        F.avg("consensus").alias("stability"), F.avg("family_consensus").alias("family_stability"), F.count("*").alias("n_units"),
        F.avg(F.col("is_anchor").cast("double")).alias("anchor_frac"), F.count_if("tied").alias("tied_units"),
    )


def anchor_summary(c: Collation, units: DataFrame | None = None) -> DataFrame:
    units = unit_stability(c) if units is None else units
    return units.agg(
        F.count("*").alias("n_units"), F.avg("consensus").alias("mean_consensus"), F.avg("family_consensus").alias("mean_family_consensus"),
        F.count_if("is_anchor").alias("n_anchor"), F.count_if("is_family_anchor").alias("n_family_anchor"), F.count_if("tied").alias("n_tied"),
    )


def ranked_verses(verses: DataFrame, column: str, k: int, lowest: bool = True) -> DataFrame:
    """The k verses of least (or greatest) value; verses without one are dropped, ties go by place."""
    order = F.asc(column) if lowest else F.desc(column)
    return verses.dropna(subset=[column]).orderBy(order, "chapter", "verse").limit(k)


# ---- families --------------------------------------------------------------------------------------


def family_vote(c: Collation, without: str | None = None) -> DataFrame:
    """Families' pluralities (raw policy): (app_id, chapter, verse_id, n_families, family_instability, between_family_split)."""
    rows = labelled(c, one_reading(c, "raw", with_base=True)).select("app_id", "family", "reading_id", "is_lemma")
    if without is not None:
        rows = rows.filter(F.col("family") != without)
    votes = plurality(rows, ["app_id", "family"], "reading_id", F.max(F.coalesce(F.col("is_lemma"), F.lit(False))).alias("lemma"))
    each = votes.groupBy("app_id").agg(F.count("*").alias("n_families"), F.count_if(~F.col("lemma")).alias("n_div"), F.countDistinct("reading_id").alias("n_distinct"))
    units = main_units(c).select("app_id", "chapter", "verse_id")
    return units.join(each, "app_id").select(*units.columns, "n_families", (F.col("n_div") / F.col("n_families")).alias("family_instability"), (F.col("n_distinct") > 1).alias("between_family_split"))


def chapter_comparison(c: Collation, vote: DataFrame | None = None, chapters: DataFrame | None = None) -> DataFrame:
    """Flat (mean over verses) beside family instability (mean over units) of chapters."""
    vote = family_vote(c) if vote is None else vote
    chapters = chapter_metrics(c) if chapters is None else chapters
    fam = vote.groupBy("chapter").agg(F.avg("family_instability").alias("family_instability"), F.avg(F.col("between_family_split").cast("double")).alias("between_family_split"))
    return chapters.select("chapter", F.col("instability").alias("flat_instability"), "n_units").join(fam, "chapter")


def leave_one_out(c: Collation, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(dropped, chapter, full, loo): chapter family instability with and without each family.

    Each family's vote doesn't depend on the others, so votes are counted once and the dropped family is
    left out of the unit's aggregate."""
    rows = labelled(c, one_reading(c, "raw", with_base=True)).select("app_id", "family", "reading_id", "is_lemma")
    votes = plurality(rows, ["app_id", "family"], "reading_id", F.max(F.coalesce(F.col("is_lemma"), F.lit(False))).alias("lemma")).select("app_id", "family", "lemma")
    units = main_units(c).select("app_id", "chapter")
    per_unit = votes.groupBy("app_id").agg(
        F.avg((~F.col("lemma")).cast("double")).alias("full"),
        *[F.avg(F.when(F.col("family") != f, (~F.col("lemma")).cast("double"))).alias(f"_{i}") for i, f in enumerate(families)],
    )
    by = per_unit.join(units, "app_id").groupBy("chapter").agg(F.avg("full").alias("full"), *[F.avg(f"_{i}").alias(f"_{i}") for i in range(len(families))])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("dropped"), F.col(f"_{i}").alias("loo")) for i, f in enumerate(families)]))
    return by.select("chapter", "full", pairs.alias("p")).select("p.dropped", "chapter", "full", "p.loo")


def spearman_leave_one_out(c: Collation, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(dropped, rho): rank correlation of the chapter map with each family dropped; null where all chapters tie."""
    rows = leave_one_out(c, families).dropna(subset=["full", "loo"])
    ranked = rows.withColumn("a", average_rank("full", "dropped")).withColumn("b", average_rank("loo", "dropped"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return ranked.groupBy("dropped").agg((F.covar_pop("a", "b") / F.nullif(spread, F.lit(0.0))).alias("rho"))


def chapter_thirds(chapters: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Is chapter ``low`` in the lowest third of ``column``, and ``high`` in the highest?"""
    ranked = chapters.withColumn("rank", average_rank(column))
    n = F.count("*")
    rank = lambda ch, missing: F.coalesce(F.max(F.when(F.col("chapter") == ch, F.col("rank"))), missing)
    return ranked.agg((rank(low, n) <= n / 3).alias("low_stays_low"), (rank(high, F.lit(0)) >= 2 * n / 3).alias("high_stays_high"))


def assign_families(witnesses: DataFrame, known: dict[str, tuple[str, list[str]]], largest: DataFrame | None = None) -> DataFrame:
    """(base_ga, family, family_source): listed families in their order, then the largest cluster, else other.

    ``known``: family -> (source, witnesses).  ``largest``: witnesses of the largest cluster.
    """
    out = witnesses.select("base_ga").distinct()
    out = out.join(largest.select("base_ga", F.lit(True).alias("_big")), "base_ga", "left") if largest is not None else out.withColumn("_big", F.lit(None).cast("boolean"))
    family, source = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, (why, members) in known.items():
        family, source = family.when(F.col("base_ga").isin(members), name), source.when(F.col("base_ga").isin(members), why)
    return out.select("base_ga", family.when(F.col("_big"), "Byz").otherwise("other").alias("family"), source.when(F.col("_big"), "cluster").otherwise("unassigned").alias("family_source"))


def witness_weights(witnesses: DataFrame) -> DataFrame:
    """Each witness weighs one by its family's size; unrelated ones weigh 1."""
    size = F.count("*").over(Window.partitionBy("family"))
    return witnesses.withColumn("weight", F.when(F.col("family") == "other", 1.0).otherwise(1.0 / size))


def family_support(c: Collation, verse_id: str | None = None) -> DataFrame:
    """Witnesses and families behind each reading (of one verse)."""
    units = main_units(c) if verse_id is None else main_units(c).filter(F.col("verse_id") == verse_id)
    # witnesses are counted as rows, whose families are one array, in steps that share one shuffle by unit; the
    # texts join the counts
    seen = c.attestation.select("app_id", "reading_id", "base_ga").join(units.select("app_id"), "app_id", "left_semi").distinct()
    known = bounded(c.witnesses.groupBy("base_ga").agg(F.collect_set("family").alias("_f")))
    each = seen.join(known, "base_ga", "left").groupBy("app_id", "reading_id").agg(F.count("base_ga").alias("n_wit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_f")))).alias("_f"))
    each = each.select("app_id", F.col("reading_id").alias("_r"), "n_wit", F.size("_f").cast("long").alias("n_families"), F.array_join("_f", ",").alias("families"))
    readings = c.readings.filter(not_lacuna(c)).select("app_id", "reading_id", "reading_type", "is_lemma", F.substring("reading_text", 1, 24).alias("txt")).distinct()
    met = readings.join(each, "app_id").filter((F.col("reading_id") <= F.col("_r")) & (F.col("reading_id") >= F.col("_r")))
    return met.select("app_id", "reading_id", "reading_type", "is_lemma", "txt", "n_wit", "n_families", "families")


# ---- confidence and the verse index ---------------------------------------------------------------


def confidence(c: Collation) -> DataFrame:
    """(verse_id, n_families, eff_families, n_early): breadth, Simpson's effective number, early witnesses."""
    seen = extant(c).distinct()
    known = bounded(c.witnesses.select("base_ga", "family", (F.coalesce(F.col("date_mid") <= c.settings.early_until, F.lit(False))).alias("early")))
    counts = seen.join(known, "base_ga", "left").groupBy("verse_id", F.coalesce("family", F.lit("other")).alias("family")).agg(F.count("*").alias("n"), F.count_if("early").alias("e"))
    total = F.sum("n")
    return counts.groupBy("verse_id").agg(
        F.count("*").alias("n_families"), (F.pow(total.cast("double"), F.lit(2.0)) / F.sum(F.col("n").cast("double") * F.col("n"))).alias("eff_families"), F.sum("e").alias("n_early")
    )


def verse_index(c: Collation) -> DataFrame:
    """All metrics of a verse in one row, with the low-confidence flag."""
    c = settled(c)
    zero = F.lit(0).cast("long")
    vote = family_vote(c).groupBy("verse_id").agg(F.avg("family_instability").alias("family_instability"), F.avg(F.col("between_family_split").cast("double")).alias("between_family_split"))
    stable = verse_stability(c).select("verse_id", "stability", "family_stability", "anchor_frac", "tied_units")
    out = verse_metrics(c).select("verse_id", "chapter", "verse", "n_units", "instability", F.col("extant_base_ms").alias("coverage"))
    out = out.join(stable, "verse_id", "left").join(vote, "verse_id", "left").join(confidence(c), "verse_id", "left")
    out = out.withColumns({n: F.coalesce(n, zero) for n in ("tied_units", "n_families", "n_early")})
    low = T.low_confidence(F.col("n_early"), F.col("n_families"), F.col("eff_families"), c.settings)
    return out.withColumn("ref", T.reference(c.settings.title, "chapter", "verse")).withColumn("low_conf", F.coalesce(low, F.lit(True)))


def contested(index: DataFrame, k: int = 12) -> DataFrame:
    """The k verses of least family stability that are well attested."""
    return ranked_verses(index.filter(~F.col("low_conf")), "family_stability", k)


# ---- drill-down -------------------------------------------------------------------------------------


def containers(units: DataFrame) -> DataFrame:
    """Units that strictly contain another unit of their verse; without both offsets a unit is none.

    Units of a verse aren't compared with each other: of each start, the least end of its units and the least end of
    units that start later tell whether there is one inside."""
    placed = units.select("verse_id", "app_id", "app_from", "app_to").dropna(subset=["verse_id", "app_from", "app_to"])
    starts = placed.groupBy("verse_id", "app_from").agg(F.min("app_to").alias("_own"))
    later = F.min("_own").over(Window.partitionBy("verse_id").orderBy(F.desc("app_from")).rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.col("app_to") > F.col("_own")) | F.coalesce(F.col("app_to") >= F.col("_later"), F.lit(False))
    return placed.join(starts.withColumn("_later", later), ["verse_id", "app_from"]).filter(inside).select("verse_id", "app_id")


def reading_families(c: Collation) -> DataFrame:
    """(app_id, reading_id, family, n): witnesses of each family behind each reading, without the base text."""
    rows = with_family(c, attested(c).select("app_id", "reading_id", "base_ga"))
    # one row for each witness and family, so counting needs no sets
    return rows.select("app_id", "reading_id", "base_ga", "family").distinct().groupBy("app_id", "reading_id", "family").agg(F.count("base_ga").alias("n"))


def reading_witnesses(c: Collation) -> DataFrame:
    """(app_id, reading_id, wits, n_wit): sorted witnesses of each reading."""
    out = attested(c).groupBy("app_id", "reading_id").agg(F.sort_array(F.collect_set("base_ga")).alias("wits"))
    return out.withColumn("n_wit", F.size("wits").cast("long"))


def unit_drilldown(c: Collation) -> DataFrame:
    """Each main unit with its readings, as nested columns, its variation and weight tier."""
    fams = reading_families(c).groupBy("app_id", "reading_id").agg(F.sort_array(F.collect_list(F.struct("family", "n"))).alias("families"))
    readings = c.readings.filter(not_lacuna(c)).join(reading_witnesses(c), ["app_id", "reading_id"], "left").join(fams, ["app_id", "reading_id"], "left")
    one = F.struct(
        "reading_id", "reading_type", "reading_text", F.coalesce("is_lemma", F.lit(False)).alias("is_lemma"), F.coalesce("n_wit", F.lit(0).cast("long")).alias("n_wit"), "families",
        F.coalesce("wits", F.array().cast("array<string>")).alias("wits"),
    )
    units = main_units(c).select("app_id", "verse_id", "chapter", "verse", "app_from", "app_to", "lemma_text")
    out = units.join(readings.groupBy("app_id").agg(F.sort_array(F.collect_list(one)).alias("readings")), "app_id")
    out = out.join(family_vote(c).select("app_id", "n_families", "family_instability", "between_family_split"), "app_id", "left")
    out = out.join(containers(units).withColumn("container", F.lit(True)).drop("verse_id"), "app_id", "left")
    away = F.filter("readings", lambda r: (r["n_wit"] > 0) & ~r["is_lemma"])
    out = out.withColumns(
        {
            "has_variation": F.size(F.filter("readings", lambda r: r["n_wit"] > 0)) >= 2,
            "orthographic": (F.size(away) > 0) & F.forall(away, lambda r: r["reading_type"].eqNullSafe(c.settings.folded_type)),
            "n_variant_wit": F.aggregate(away, F.lit(0).cast("long"), lambda s, r: s + r["n_wit"]),
            "readings": F.filter("readings", lambda r: (r["n_wit"] > 0) | r["is_lemma"]),
            "container": F.coalesce("container", F.lit(False)),
            "family_instability": F.coalesce("family_instability", F.lit(0.0)),
            "between_family_split": F.coalesce("between_family_split", F.lit(False)),
            "n_families": F.coalesce("n_families", F.lit(0).cast("long")),
        }
    )
    tier = T.weight_tier(F.col("between_family_split"), F.col("family_instability"), F.col("n_variant_wit"))
    return out.withColumn("weight", tier).withColumn("n_fam_div", F.round(F.col("family_instability") * F.col("n_families")).cast("long"))


def verse_drilldown(c: Collation, english: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
    """Each verse: its running text, slots that tile it, variation units, and whole-verse variation."""
    units = unit_drilldown(c) if units is None else units
    var, lemma = F.col("has_variation"), F.col("lemma_text")
    major = F.col("between_family_split") | (F.col("family_instability") > 0)
    slot = F.struct(
        F.coalesce("app_from", F.lit(0)).alias("from"), F.coalesce("app_to", F.lit(0)).alias("to"), "app_id", F.when(var, F.col("app_id")).alias("app"), lemma.alias("text"), F.coalesce(lemma == "om", F.lit(False)).alias("om"),
        var.alias("var"), (var & F.col("orthographic")).alias("orth"), F.when(var, F.when(major, "major").otherwise("minor")).alias("wt"),
    )
    card = F.struct(F.coalesce("app_from", F.lit(0)).alias("from"), F.coalesce("app_to", F.lit(0)).alias("to"), "app_id", "lemma_text", "readings", "n_variant_wit", "orthographic", "between_family_split", "n_families", "n_fam_div", "weight")
    out = units.groupBy("chapter", "verse", "verse_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("container"), slot))).alias("slots"),
        F.collect_list(F.when(~F.col("container") & var, card)).alias("units"),
        F.collect_list(F.when(F.col("container") & var, card)).alias("whole_verse"),
        F.count("*").alias("n_units_total"),
    )
    by_place = lambda cards: F.array_sort(cards, lambda a, b: F.when(a["from"] != b["from"], F.sign(a["from"] - b["from"])).when(a["to"] != b["to"], F.sign(a["to"] - b["to"])).when(a["app_id"] < b["app_id"], -1).otherwise(1).cast("int"))
    out = out.withColumns({"units": by_place("units"), "whole_verse": by_place("whole_verse")})
    said = F.filter("slots", lambda s: s["text"].isNotNull() & (s["text"] != "") & ~s["om"])
    out = out.withColumn("text", F.array_join(F.transform(said, lambda s: s["text"]), " "))
    out = out.withColumn("n_variation_units", (F.size("units") + F.size("whole_verse")).cast("long")).withColumn("ref", T.reference(c.settings.title, "chapter", "verse"))
    return out.join(english, "verse_id", "left") if english is not None else out.withColumn("english", F.lit(None).cast("string"))


# ---- whole-store figures ---------------------------------------------------------------------------


def store_summary(c: Collation) -> DataFrame:
    """Eight integrity counts in one row."""
    kind = F.col("app_type")
    u = c.units.agg(
        F.count("*").alias("units_total"), F.count_if(kind == c.settings.main_type).alias("units_main"), F.count_if(kind == c.settings.lacuna_type).alias("units_lac"),
        F.countDistinct("verse_id").alias("verses"), F.countDistinct("chapter").alias("chapters"),
    )
    r = c.readings.agg(F.count("*").alias("readings"))
    a = c.attestation.agg(F.count("*").alias("attestations"), F.countDistinct("base_ga").alias("distinct_base_ga"))
    return u.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(a))  # one row each


def corpus_summary(c: Collation, index: DataFrame | None = None) -> DataFrame:
    index = verse_index(c) if index is None else index
    medians = index.agg(F.floor(F.median("coverage")).cast("long").alias("median_witnesses_per_verse"), F.round(F.median("eff_families"), 2).alias("eff_families_median"))
    u = c.units.agg(F.count_if(F.col("app_type") == c.settings.main_type).alias("n_units"), F.countDistinct("verse_id").alias("n_verses"))
    a = c.attestation.agg(F.count("*").alias("n_attestations"), F.countDistinct(F.when(F.col("base_ga") != c.settings.base_witness, F.col("base_ga"))).alias("n_witnesses"))
    return u.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(medians))


def chapter_summary(c: Collation) -> DataFrame:
    """Chapters with flat, family and stability means."""
    c = settled(c)
    stable = verse_stability(c).groupBy("chapter").agg(F.avg("stability").alias("stability"), F.avg("family_stability").alias("family_stability"))
    fam = chapter_comparison(c).select("chapter", "family_instability", "between_family_split")
    return chapter_metrics(c).join(fam, "chapter", "left").join(stable, "chapter", "left")


# ---- witnesses' dates ------------------------------------------------------------------------------


def enrich_dates(witnesses: DataFrame, dates: DataFrame) -> DataFrame:
    """Witnesses with docid, date_early, date_late, date_mid from (docid, orig); earlier columns are replaced."""
    base = witnesses.drop("docid", "date_early", "date_late", "date_mid").withColumn("docid", T.ga_to_docid("base_ga"))
    out = base.join(dates.select("docid", T.parse_orig("orig").alias("_d")), "docid", "left")
    out = out.withColumn("date_early", F.col("_d.date_early")).withColumn("date_late", F.col("_d.date_late"))
    return out.withColumn("date_mid", T.midpoint("date_early", "date_late")).drop("_d")


def includers_omitters(c: Collation, verse_id: str, neighbours: list[str]) -> DataFrame:
    """(base_ga, role): witnesses of the passage's own readings, and those that are extant on either side without it."""
    # the units of a few verses, to which the attestation is narrowed before it is shuffled
    asked = written(main_units(c).filter(F.col("verse_id").isin(verse_id, *neighbours)).select("app_id", "verse_id"), "asked")
    own = bounded(asked)
    main = attested(c, units=own.select("app_id")).join(own, "app_id")
    include = main.filter((F.col("verse_id") == verse_id) & F.col("reading_type").isNull()).select("base_ga").distinct()
    here = own.filter(F.col("verse_id") == verse_id).select("app_id")
    gaps = c.readings.filter(F.col("reading_type") == c.settings.lacuna_type).select("app_id", "reading_id").join(here, "app_id", "left_semi")
    lost = c.attestation.filter(F.col("base_ga") != c.settings.base_witness).join(here, "app_id", "left_semi").join(gaps, ["app_id", "reading_id"], "left_semi").select("base_ga").distinct()
    near = main.filter(F.col("verse_id").isin(neighbours)).select("base_ga").distinct()
    omit = near.join(include, "base_ga", "left_anti").join(lost, "base_ga", "left_anti")
    return include.withColumn("role", F.lit("includer")).union(omit.withColumn("role", F.lit("omitter")))


# ---- covariates --------------------------------------------------------------------------------------


def verse_covariates(c: Collation) -> DataFrame:
    """Verses with instability of families, coverage, length, lectionaries, families, section and synoptic flag."""
    c = settled(c)
    units = main_units(c).select("app_id", "verse_id", "app_to")
    length = units.groupBy("verse_id").agg(F.max("app_to").alias("verse_length"))
    lect = attested(c, with_base=True).filter(F.startswith("base_ga", F.lit("L"))).join(units.select("app_id", "verse_id"), "app_id").groupBy("verse_id").agg(F.countDistinct("base_ga").alias("n_lectionaries"))
    fam = family_vote(c).groupBy("verse_id").agg(
        F.avg("family_instability").alias("family_instability"), F.avg(F.col("between_family_split").cast("double")).alias("between_family_split"), F.count("*").alias("n_units_fam")
    )
    out = verse_metrics(c).select("chapter", "verse", "verse_id", F.col("extant_base_ms").alias("coverage")).join(length, "verse_id").join(lect, "verse_id", "left").join(fam, "verse_id", "left")
    out = out.join(confidence(c).select("verse_id", "n_families"), "verse_id", "left").fillna({"n_lectionaries": 0}).dropna(subset=["between_family_split"])
    return out.withColumn("synoptic", T.is_synoptic("chapter", "verse").cast("int")).withColumn("section", T.section("chapter", "verse"))


def standardised_covariates(c: Collation) -> DataFrame:
    return z_scores(verse_covariates(c), ["coverage", "verse_length", "n_lectionaries", "n_families"])



