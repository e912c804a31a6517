"""Pairwise coherence of witnesses: which units inform, agreement of pairs, neighbours, clusters' agreement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.choose import one_reading
from ..operators.statistics import numbered
from ..schema import Collation, bounded, written


def reading_matrix(c: Collation, min_units: int | None = None) -> DataFrame:
    """Long matrix (app_id, base_ga, reading_id) of one reading a witness, without sparse witnesses."""
    least = c.settings.min_units if min_units is None else min_units
    rows = written(one_reading(c, "raw").select("app_id", "base_ga", "reading_id"), "chosen")
    kept = written(rows.groupBy("base_ga").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("base_ga"), "kept")
    return rows.join(bounded(kept), "base_ga", "left_semi").select("app_id", "base_ga", "reading_id")


def informative(matrix: DataFrame, min_extant: int = 30, max_modal: float = 0.90) -> DataFrame:
    """The matrix of the informative units, written once."""
    matrix = matrix.repartition("app_id")  # units and rows meet without a further shuffle
    units = informative_units(matrix, min_extant, max_modal)
    return written(matrix.join(units.select("app_id"), "app_id", "left_semi"), "informative")


def codes(matrix: DataFrame) -> DataFrame:
    """The matrix with ``code``: the rank of the reading among the readings of its unit, from 0."""
    rank = F.dense_rank().over(Window.partitionBy("app_id").orderBy("reading_id"))
    return matrix.select("app_id", "base_ga", "reading_id", (rank - 1).cast("int").alias("code"))


def informative_units(matrix: DataFrame, min_extant: int = 30, max_modal: float = 0.90) -> DataFrame:
    """(app_id, n_extant, modal_share) of the well attested units whose commonest reading isn't near-unanimous."""
    counts = matrix.groupBy("app_id", "reading_id").agg(F.count("*").alias("n"))
    share = counts.groupBy("app_id").agg(F.sum("n").alias("n_extant"), (F.max("n") / F.sum("n")).alias("modal_share"))
    return share.filter((F.col("n_extant") >= min_extant) & (F.col("modal_share") < max_modal))


@dataclass(frozen=True)
class Near:
    """The witnesses (base_ga), and those pairs (w1, w2, distance), w1 < w2, whose distance is below 1.

    All other pairs are at distance 1, so what is asked of all pairs follows from these and from counts: the pairs
    grow with the square of the witnesses, these with the readings."""

    who: DataFrame
    pairs: DataFrame


def near_of(pairs: DataFrame | Near) -> Near:
    """The same of a table of all pairs (w1, w2, distance)."""
    if isinstance(pairs, Near):
        return pairs
    who = pairs.select(F.col("w1").alias("base_ga")).union(pairs.select("w2")).distinct()
    return Near(who, pairs.filter("distance < 1").select("w1", "w2", "distance"))


def cells(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix by numbers (app_id, i, code), and its witnesses (base_ga, i), numbered in string order from 0."""
    who = written(numbered(matrix, "base_ga", "i"), "witnesses")
    rank = F.dense_rank().over(Window.partitionBy("app_id").orderBy("reading_id"))
    return matrix.join(bounded(who), "base_ga").repartition("app_id").select("app_id", "i", (rank - 1).cast("int").alias("code")), who


def tails(told: DataFrame, *carried: str) -> DataFrame:
    """(i, t, carried): for each witness of a unit those from itself onwards, as 2 j, plus 1 where the readings agree.

    These arrays are shuffled, by i, and not the pairs, of which there are several for each number."""
    packed = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("code").cast("long"))
    one = told.groupBy("app_id", *carried).agg(F.sort_array(F.collect_list(packed)).alias("w"))
    each = one.select(*carried, "w", F.posexplode("w").alias("_at", "p"))
    code = lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF))
    t = F.transform(F.slice("w", F.col("_at") + 1, F.size("w")), lambda q: (F.shiftright(q, 32) * 2 + (code(q) == code(F.col("p"))).cast("int")).cast("int"))
    return each.select(F.shiftright("p", 32).cast("int").alias("i"), t.alias("t"), *carried).repartition("i")


def pair_counts(told: DataFrame) -> DataFrame:
    """(i, j, overlap, agree) of all pairs of numbered witnesses that share a unit, i <= j (each with itself, too).

    Pairs come from arrays after the shuffle, so they are counted where they are made."""
    return tails(told).select("i", F.explode("t").alias("e")).groupBy("i", F.shiftright("e", 1).alias("j")).agg(F.count("*").alias("overlap"), F.sum(F.col("e").bitwiseAND(F.lit(1))).alias("agree"))


def linked(matrix: DataFrame, min_overlap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(base_ga, i), and (i, j, distance) of the pairs i < j of them that are nearer than 1."""
    told, who = cells(matrix)
    pairs = pair_counts(told).filter((F.col("i") < F.col("j")) & (F.col("overlap") >= min_overlap) & (F.col("agree") > 0))
    return who, pairs.select("i", "j", (1.0 - F.col("agree") / F.col("overlap")).alias("distance"))


def near(matrix: DataFrame, min_overlap: int = 100) -> Near:
    """``Near`` of a matrix, its pairs written once."""
    who, pairs = linked(matrix, min_overlap)
    known = bounded(who)
    name = lambda w, n: known.select(F.col("base_ga").alias(w), F.col("i").alias(n))
    named = written(pairs, "near").join(name("w1", "i"), "i").join(name("w2", "j"), "j").select("w1", "w2", "distance")
    return Near(who.select("base_ga"), named)


def distances(matrix: DataFrame, min_overlap: int = 100) -> DataFrame:
    """(w1, w2, overlap, agreement, distance) of all pairs: 1 - agreement, and 1 where they share too few units.

    Pairs that share no unit are filled in between those that do, in place: all pairs are made, but never shuffled."""
    told, who = cells(matrix)
    n = who.count()
    after = F.lead("j", 1, n).over(Window.partitionBy("i").orderBy("j"))
    known = pair_counts(told).withColumn("_next", after).join(bounded(who).withColumnRenamed("base_ga", "w1"), "i")
    # from the pair itself (a witness with itself is none) up to the next one
    start = F.when(F.col("i") == F.col("j"), F.col("j") + 1).otherwise(F.col("j"))
    filled = known.select("w1", "j", "overlap", "agree", F.explode(F.when(start < F.col("_next"), F.sequence(start, F.col("_next") - 1))).alias("_at"))
    there = F.col("_at") == F.col("j")
    out = filled.join(bounded(who).select(F.col("base_ga").alias("w2"), F.col("i").alias("_at")), "_at")
    overlap = F.when(there, F.col("overlap")).otherwise(F.lit(0).cast("long"))
    agreement = F.when(there, F.col("agree") / F.col("overlap"))
    return out.select("w1", "w2", overlap.alias("overlap"), agreement.alias("agreement"), F.when(overlap < min_overlap, 1.0).otherwise(1.0 - agreement).alias("distance"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("w1", "w2", "distance").union(pairs.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "distance"))


def nearest(pairs: DataFrame | Near, k: int = 1) -> DataFrame:
    """(w1, w2, distance, nth): the k nearest of each witness, ties by name.

    After those nearer than 1 come the first names at distance 1, of which 2 k + 1 are enough to choose from."""
    given = near_of(pairs)
    nth = F.row_number().over(Window.partitionBy("w1").orderBy("distance", "w2"))
    best = both_ways(given.pairs).withColumn("nth", nth).filter(F.col("nth") <= k)
    best = best.groupBy("w1").agg(F.sort_array(F.collect_list(F.struct("distance", "w2"))).alias("_own"))
    first = given.who.orderBy("base_ga").limit(2 * k + 1).agg(F.sort_array(F.collect_list("base_ga")).alias("_first"))  # one row
    met = given.who.select(F.col("base_ga").alias("w1")).join(best, "w1", "left").crossJoin(F.broadcast(first))
    own = F.coalesce("_own", F.array().cast("array<struct<distance:double,w2:string>>"))
    rest = F.filter("_first", lambda w: (w != F.col("w1")) & ~F.exists(own, lambda o: o["w2"] == w))
    listed = F.slice(F.concat(own, F.transform(rest, lambda w: F.struct(F.lit(1.0).alias("distance"), w.alias("w2")))), 1, k)
    return met.select("w1", F.posexplode(listed).alias("_k", "_v")).select("w1", "_v.w2", "_v.distance", (F.col("_k") + 1).alias("nth"))


def _families(given: Near, families: DataFrame) -> DataFrame:
    """(base_ga, family, m) of the witnesses with a family; m rows each."""
    f = families.filter(F.col("family").isNotNull()).groupBy("base_ga", "family").agg(F.count("*").alias("m"))
    return written(f.join(given.who, "base_ga", "left_semi"), "families")


def homogeneity(pairs: DataFrame | Near, families: DataFrame) -> DataFrame:
    """(family, homogeneity): 1 - mean distance of the pairs within a family."""
    given = near_of(pairs)
    f = _families(given, families)
    known = bounded(f)
    met = given.pairs.join(known.select(F.col("base_ga").alias("w1"), "family", F.col("m").alias("_m1")), "w1").join(known.select(F.col("base_ga").alias("w2"), F.col("family").alias("_f2"), F.col("m").alias("_m2")), "w2")
    close = met.filter(F.col("family") == F.col("_f2")).groupBy("family").agg(F.sum((1.0 - F.col("distance")) * F.col("_m1") * F.col("_m2")).alias("s"))
    n = (F.pow(F.sum("m").cast("double"), F.lit(2.0)) - F.sum(F.col("m") * F.col("m"))) / 2.0
    sizes = f.groupBy("family").agg(n.alias("n")).filter("n > 0")
    mean = (F.col("n") - F.coalesce("s", F.lit(0.0))) / F.col("n")
    return sizes.join(close, "family", "left").select("family", (1.0 - mean).alias("homogeneity"))


def silhouette_points(pairs: DataFrame | Near, families: DataFrame) -> DataFrame:
    """(base_ga, family, silhouette) of labelled witnesses; witnesses alone in their family are skipped."""
    given = near_of(pairs)
    f = _families(given, families)
    known = bounded(f)
    other = known.select(F.col("base_ga").alias("w2"), F.col("family").alias("f2"), "m")
    close = both_ways(given.pairs).join(other, "w2").groupBy("w1", "f2").agg(F.sum((1.0 - F.col("distance")) * F.col("m")).alias("s"))
    own = known.select(F.col("base_ga").alias("w1"), F.col("family").alias("f2"), F.col("m").alias("_own"))
    sizes = bounded(f.groupBy(F.col("family").alias("f2")).agg(F.sum("m").alias("n")))
    met = f.select(F.col("base_ga").alias("w1"), "family").crossJoin(sizes).join(own, ["w1", "f2"], "left").join(close, ["w1", "f2"], "left")
    n = F.col("n") - F.coalesce("_own", F.lit(0).cast("long"))
    means = met.filter(n > 0).select("w1", "family", "f2", ((n - F.coalesce("s", F.lit(0.0))) / n).alias("d"))
    each = means.groupBy("w1", "family").agg(F.max(F.when(F.col("family") == F.col("f2"), F.col("d"))).alias("a"), F.min(F.when(F.col("family") != F.col("f2"), F.col("d"))).alias("b"))
    most = F.greatest("a", "b")
    return each.dropna(subset=["a", "b"]).select(F.col("w1").alias("base_ga"), "family", F.when(most > 0, (F.col("b") - F.col("a")) / most).otherwise(0.0).alias("silhouette"))


def silhouette(pairs: DataFrame | Near, families: DataFrame) -> DataFrame:
    """(family, silhouette), and the mean over all points as family ``overall``."""
    points = written(silhouette_points(pairs, families), "silhouettes")
    by = points.groupBy("family").agg(F.avg("silhouette").alias("silhouette"))
    return by.union(points.agg(F.lit("overall").alias("family"), F.avg("silhouette").alias("silhouette")))


def _pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """One row (ari) from a contingency table; 1 where the index is undefined."""
    cells = rows.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    ones = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(_pairs_of(F.col("n"))).alias(f"s{k}"))
    total = cells.agg(F.sum(_pairs_of(F.col("n"))).alias("c"), _pairs_of(F.sum("n")).alias("all"))
    met = total.crossJoin(F.broadcast(ones("t"))).crossJoin(F.broadcast(ones("p")))  # one row each
    expected = F.when(F.col("all") != 0, F.col("st") * F.col("sp") / F.nullif(F.col("all"), F.lit(0.0))).otherwise(0.0)
    room = (F.col("st") + F.col("sp")) / 2 - expected
    return met.select(F.when(room != 0, (F.col("c") - expected) / F.nullif(room, F.lit(0.0))).otherwise(1.0).alias("ari"))


def v_measure(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """One row (homogeneity, completeness, v_measure) by entropies in natural logarithms."""
    cells = rows.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy())  # few cells: labels x clusters
    met = cells.withColumn("all", n).withColumn("nt", F.sum("n").over(Window.partitionBy("t"))).withColumn("np", F.sum("n").over(Window.partitionBy("p")))
    share = F.col("n") / F.col("all")
    sums = met.agg(
        (-F.sum(share * F.log(F.col("nt") / F.col("all")))).alias("ht"), (-F.sum(share * F.log(F.col("np") / F.col("all")))).alias("hp"),
        (-F.sum(share * F.log(F.col("n") / F.col("np")))).alias("htp"), (-F.sum(share * F.log(F.col("n") / F.col("nt")))).alias("hpt"),
    )
    h = F.when(F.col("ht") != 0, 1 - F.col("htp") / F.nullif(F.col("ht"), F.lit(0.0))).otherwise(1.0)
    c = F.when(F.col("hp") != 0, 1 - F.col("hpt") / F.nullif(F.col("hp"), F.lit(0.0))).otherwise(1.0)
    return sums.select(h.alias("homogeneity"), c.alias("completeness"), F.when(h + c != 0, 2 * h * c / F.nullif(h + c, F.lit(0.0))).otherwise(0.0).alias("v_measure"))
