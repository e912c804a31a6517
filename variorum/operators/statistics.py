"""Statistics as DataFrame operators: ranks, z-scores, quantiles, resampling, tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def z_scores(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Columns standardised by mean and population standard deviation (null where that is 0)."""
    one = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(one))  # one row
    for c in columns:
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)))
    return out.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def average_rank(column: str, *keys: str) -> Column:
    """Ranks from 1, ties share their mean.  Values that differ by less than 1e-9 are ties, as means of equal
    numbers may differ by the order of their sums."""
    value = F.round(F.col(column).cast("double"), 9)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    same = F.count("*").over(Window.partitionBy(*keys, value))
    return rank + (same - 1) / 2


#: Into how many ranges a column is cut where it is ranked as a whole.
RANGES = 64


def cumulated(df: DataFrame, value: str | Column) -> DataFrame:
    """(value, n, before, part): each distinct value with its rows, the rows of lesser values, and its range.

    The column as a whole, without a task that sees all of it: values are counted, cut into ranges at
    approximate quantiles (which only balance the tasks), and summed within ranges and over the ranges."""
    counts = df.select((F.col(value) if isinstance(value, str) else value).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    marks = [k / RANGES for k in range(1, RANGES)]
    cut = counts.agg(F.percentile_approx("value", marks, 10_000).alias("_cut"))  # one row
    dealt = counts.crossJoin(F.broadcast(cut)).withColumn("part", F.size(F.filter("_cut", lambda c: c < F.col("value")))).drop("_cut")
    sums = dealt.groupBy("part").agg(F.sum("n").alias("n"))  # at most RANGES rows
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(first), F.lit(0).cast("long")).alias("_base"))
    own = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, "part").select("value", "n", (F.col("_base") + F.coalesce(F.sum("n").over(own), F.lit(0).cast("long"))).alias("before"), "part")


def ranked(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """``df`` (rows with a value) with the mean rank of each row in the whole column, ties as in ``average_rank``."""
    value = F.round(F.col(column).cast("double"), 9)
    ranks = cumulated(df, value).select(F.col("value").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return df.withColumn("_v", value).join(ranks, "_v").drop("_v")


def numbered(df: DataFrame, column: str, out: str = "at") -> DataFrame:
    """(column, out): each distinct value (null is none) with its place from 0 in ascending order.

    Values are cut into ranges at values drawn by hash, which only balance the tasks; no task sees all."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    drawn = values.orderBy(F.xxhash64(column), column).limit(64 * RANGES).agg(F.sort_array(F.collect_list(column)).alias("_all"))
    marks = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda k: F.get("_all", F.floor(k * F.size("_all") / RANGES).cast("int")))
    dealt = values.crossJoin(F.broadcast(drawn.select(marks.alias("_cut")))).select(column, F.size(F.filter("_cut", lambda c: c < F.col(column))).alias("_part"))  # one row
    sums = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # at most RANGES rows
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return dealt.withColumn("_own", own).join(F.broadcast(sums), "_part").select(column, (F.col("_base") + F.col("_own") - 1).cast("int").alias(out))


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "p_fdr", keys: tuple[str, ...] = ()) -> DataFrame:
    """False discovery rates of the p-values (of each group); rows without one are dropped."""
    known = df.filter(F.col(p).isNotNull())
    if keys:
        n = F.count(p).over(Window.partitionBy(*keys))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(p))
        scaled = known.withColumn("_r", rank).withColumn("_q", F.col(p) * n / F.col("_r"))
        least = F.min("_q").over(Window.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
        return scaled.withColumn(out, F.least(F.lit(1.0), least)).drop("_r", "_q")
    # of equal p-values the last rank gives the least q, so one q a value is enough
    values = cumulated(known, p)
    all_ = values.agg(F.sum("n").alias("_all"))  # one row
    values = values.crossJoin(F.broadcast(all_)).withColumn("_q", F.col("value") * F.col("_all") / (F.col("before") + F.col("n")))
    parts = values.groupBy("part").agg(F.min("_q").alias("_m"))  # at most RANGES rows
    parts = parts.select("part", F.min("_m").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    own = F.min("_q").over(Window.partitionBy("part").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    values = values.join(parts, "part").select(F.col("value").alias("_value"), F.least(F.lit(1.0), own, F.col("_later")).alias(out))
    return known.join(values, F.col(p) == F.col("_value")).drop("_value")


def lower_percentiles(df: DataFrame, keys: list[str], value: str, q: float, out: str) -> DataFrame:
    """(keys, out): of each group the value at floor(q (n - 1)) of the sorted ones, counted from 0."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(group))
    return placed.filter(F.col("_upto") > F.floor(F.lit(q) * (F.col("_all") - 1))).groupBy(*keys).agg(F.min(value).alias(out))


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: n1, n2, U of ``first``, the terms of ties, and the one-sided p that it is less (normal, ties and
    continuity corrected; ``exact_mann_whitney`` gives the exact one of small samples without ties)."""
    rows = ranked(df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()), value, "_rank")
    ties = rows.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    sums = rows.agg(
        F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) == second).alias("n2"), F.sum(F.when(F.col(group) == first, F.col("_rank"))).alias("r1")
    ).crossJoin(F.broadcast(ties))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2 + 0.5) / F.nullif(spread, F.lit(0.0))
    return sums.select("n1", "n2", u.alias("u"), F.coalesce("ties", F.lit(0.0)).alias("ties"), z.alias("z"), normal_cdf(z).alias("p_less"))


def exact_mann_whitney(u: float, n1: int, n2: int) -> float:
    """P(U <= u) without ties, by counting the arrangements: for small samples, where normal tails are off."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    # the generating function is a product of (1 - q**(n2 + i)) / (1 - q**i), i = 1 ... n1
    for i in range(1, n1 + 1):
        step = n2 + i
        for k in range(len(ways) - 1, step - 1, -1):
            ways[k] -= ways[k - step]
        for k in range(i, len(ways)):
            ways[k] += ways[k - i]
    return float(ways[: int(math.floor(u)) + 1].sum() / ways.sum())


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (error below 1e-7; Abramowitz and Stegun 26.2.17)."""
    # The coefficients of the approximation.
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the keys only, not on partitions or attempts."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def replicates(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "rep")


def block_permutation(df: DataFrame, value: str, targets: list[str], key: str = "verse_id", order: tuple[str, ...] = ("chapter", "verse")) -> DataFrame:
    """Exact test that the mean over a run of targets is lower than elsewhere: all windows of their number.

    One row: n_target, n, target_mean, rest_mean, difference, n_windows, n_as_low, p_value (the share of
    windows whose difference is as low; the target's own is one of them if it is contiguous).  The ordered
    series is short (verses), and goes through one window by its order.
    """
    rows = df.select(*order, F.col(key).alias("_key"), F.col(value).cast("double").alias("_x"))
    k = rows.filter(F.col("_key").isin(targets)).count()
    w = Window.orderBy(*order).rowsBetween(Window.currentRow, max(k, 1) - 1)
    total = rows.agg(F.sum("_x").alias("s"), F.count("*").alias("n"), F.sum(F.when(F.col("_key").isin(targets), F.col("_x"))).alias("ts"), F.count_if(F.col("_key").isin(targets)).alias("k"))
    windows = rows.withColumn("ws", F.sum("_x").over(w)).withColumn("wn", F.count("*").over(w)).filter(F.col("wn") == k)
    diff = lambda s, k, total, n: s / k - (total - s) / F.nullif(n - k, F.lit(0))
    met = windows.crossJoin(F.broadcast(total))
    obs = diff(F.col("ts"), F.col("k"), F.col("s"), F.col("n"))
    met = met.withColumn("obs", obs).withColumn("d", diff(F.col("ws"), F.col("wn"), F.col("s"), F.col("n")))
    return met.agg(
        F.max("k").alias("n_target"), F.max("n").alias("n"), F.max(F.col("ts") / F.col("k")).alias("target_mean"), F.max((F.col("s") - F.col("ts")) / (F.col("n") - F.col("k"))).alias("rest_mean"),
        F.max("obs").alias("difference"), F.count("*").alias("n_windows"), F.count_if(F.col("d") <= F.col("obs") + 1e-12).alias("n_as_low"),
    ).withColumn("p_value", F.col("n_as_low") / F.col("n_windows"))


def iid_permutation(df: DataFrame, value: str, targets: list[str], n_perm: int, seed: int, key: str = "verse_id") -> DataFrame:
    """The same test against random sets of as many rows: (n_target, difference, p_value)."""
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_x"))
    total = rows.agg(F.sum("_x").alias("s"), F.count("*").alias("n"), F.sum(F.when(F.col("_key").isin(targets), F.col("_x"))).alias("ts"), F.count_if(F.col("_key").isin(targets)).alias("k"))
    drawn = rows.crossJoin(F.broadcast(replicates(df.sparkSession, n_perm))).withColumn("_u", uniform(seed, "rep", "_key"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("_u", "_key"))
    k = df.filter(F.col(key).isin(targets)).count()
    sums = drawn.withColumn("_nth", nth).filter(F.col("_nth") <= k).groupBy("rep").agg(F.sum("_x").alias("ws"))
    met = sums.crossJoin(F.broadcast(total))
    d = lambda s: F.col(s) / F.col("k") - (F.col("s") - F.col(s)) / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    return met.agg(F.max("k").alias("n_target"), F.max(d("ts")).alias("difference"), F.count_if(d("ws") <= d("ts") + 1e-12).alias("c"), F.count("*").alias("b")).select(
        "n_target", "difference", ((F.col("c") + 1) / (F.col("b") + 1)).alias("p_value")
    )


def median_permutation(df: DataFrame, value: str, group: str, first: str, second: str, n_perm: int, seed: int, key: str) -> DataFrame:
    """Is the median of ``first`` lower than that of ``second``?  (difference, p_value); null p under 3 rows a group."""
    rows = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_x"), (F.col(group) == first).alias("_one"))
    both = lambda flag: F.expr(f"median(_x) FILTER (WHERE {flag})") - F.expr(f"median(_x) FILTER (WHERE NOT {flag})")
    obs = rows.agg(both("_one").alias("obs"), F.count_if("_one").alias("k"), F.count("*").alias("n"))
    k = rows.filter("_one").count()
    shuffled = rows.crossJoin(F.broadcast(replicates(df.sparkSession, n_perm))).withColumn("_u", uniform(seed, "rep", "_key"))
    shuffled = shuffled.withColumn("_two", F.row_number().over(Window.partitionBy("rep").orderBy("_u", "_key")) <= k)
    null = shuffled.groupBy("rep").agg(both("_two").alias("d")).crossJoin(F.broadcast(obs))
    enough = (F.max("k") >= 3) & (F.max(F.col("n") - F.col("k")) >= 3)
    return null.agg(F.max("obs").alias("difference"), F.when(enough, (F.count_if(F.col("d") <= F.col("obs")) + 1) / (F.count("*") + 1)).alias("p_value"))


def bootstrap_intervals(df: DataFrame, key: str, group: str, values: list[str], b: int, seed: int) -> DataFrame:
    """Percentile intervals (2.5, 50, 97.5) of the group means of ``values`` when rows are drawn anew.

    Rows get a Poisson(1) number of draws by hash in each replicate, as in bootstraps of distributed data
    (the number of rows varies a little from replicate to replicate); nothing is collected or joined.
    """
    # the numbers of draws by inversion: chances of 0, 1, 2, ... draws
    u, below, draws = uniform(seed, "rep", key), 0.0, F.lit(0)
    for n in range(9):
        below += math.exp(-1) / math.factorial(n)
        draws = F.when(u >= below, F.lit(n + 1)).otherwise(draws)
    drawn = df.select(key, group, *values).crossJoin(F.broadcast(replicates(df.sparkSession, b))).withColumn("_w", draws).filter("_w > 0")
    means = drawn.groupBy("rep", group).agg(*[(F.sum(F.col(v) * F.col("_w")) / F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(v) for v in values])
    marks = [("lo", 0.025), ("med", 0.5), ("hi", 0.975)]
    return means.groupBy(group).agg(*[F.percentile(v, q).alias(f"{v}_{m}") for v in values for m, q in marks])
