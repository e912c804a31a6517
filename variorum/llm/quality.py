"""Quality rules with robust multivariate outliers (operator 8), in DataFrame functions only.

Base rules: too few words, or too many words in 8-word windows that are repeated in the text.  Beyond
them, four transformed statistics of each text (mean word length, symbols for each word, capitals and
other non-letters among the characters) form a vector, and a text fails if its vector lies far from
the bulk of its language and source.

The bulk is estimated by minimum covariance determinant, with deterministic starts: medians with quartile
ranges; the correlations of squashed (tanh) and of sphered standard values; the nearest half by those values;
the plain moments.  From each start concentration steps take the ``share`` of a group with the least
Mahalanobis distances and compute centre and covariance anew.  After each step the determinants of all starts
are compared, and a group keeps the estimate of the least one it has met; steps end when no group's
determinant falls any more.  The scale is corrected for the share (as if normal) and texts beyond a far
quantile of the chi-square distribution fail.  The tail of real texts is heavier than normal, which is what
the far quantile (1 - 1e-9) allows for; a usual 0.975 would reject several times as many.

One concentration step is one pass for all starts: the moments are summed by group, start and fine bin of
distance, so the running count over the bins (some thousand at most, whatever a group's size) tells which bins
make up the share, and their moments are already there.  The last bin (of 2 % of the distance) counts for
the part of it that makes the share exact.  Statistics are integers (1/256 of their unit) and so are squashed
and sphered values, sums are exact, so results don't depend on partitions.

Sources with fewer than ``least`` texts of a language are pooled, languages whose pool has fewer are pooled
with each other; where that pool has fewer too, there is no estimate and texts pass.  Estimates reach the
texts by a broadcast of a counted size, or by group and share of the texts (``with_facts``); no task gets a
whole group.

Nulls: a null text has no words (and fails); null languages and sources are the value ''.  Columns
that have the name of a result are replaced by it.  Repeated rows are judged alike, an empty table gives an
empty result, very long texts are counted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import table, with_facts, written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
STATS = ("_v_x0", "_v_x1", "_v_x2", "_v_x3")
UNIT = 256


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(words: Column, span: int = 8) -> Column:
    """A 64-bit hash of each window of ``span`` words."""
    none = F.expr("cast(array() as array<bigint>)")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    each = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - span + 1), lambda i: F.xxhash64(F.slice(h, i, span))))
    return F.when(F.size(words) <= span, none).otherwise(each)


def covered(windows: Column, span: int = 8) -> Column:
    """How many words lie in windows that are there twice or more, first ones included.

    Only texts with an equal pair of windows pay for the search."""

    def cover(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(placed, lambda x, k: same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(False))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), union)

    def union(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.lit(span), F.coalesce(b - a, F.lit(span))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(placed, cover))


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts (_v_ prefix) and the statistics vector (_v_x0 to _v_x3)."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace("_v_t", pattern, "")).cast("long")
    docs = docs.withColumn("_v_t", t)
    words = F.filter(F.split("_v_t", BLANKS), lambda w: w != "")
    lines = F.filter(F.split("_v_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumns({"_v_words": words, "_v_lines": lines})
    docs = docs.withColumns(
        {
            "_v_n_words": F.size("_v_words").cast("long"),
            "_v_word_chars": left(BLANKS),
            "_v_n_symbols": left(SYMBOLS),
            "_v_n_dup_lines": (F.size("_v_lines") - F.size(F.array_distinct("_v_lines"))).cast("long"),
            "_v_upper": left(r"[^\p{Lu}]+"),
            "_v_letters": left(r"[^\p{L}]+"),
            "_v_windows": window_hashes(F.col("_v_words")),
        }
    )
    docs = docs.withColumn("_v_n_repeat_words", covered(F.col("_v_windows")).cast("long"))
    n, chars = F.greatest("_v_n_words", F.lit(1)), F.greatest("_v_word_chars", F.lit(1))
    whole = lambda x: F.round(F.lit(float(UNIT)) * x).cast("long")
    return docs.withColumns(
        {
            "_v_x0": whole(F.log((F.col("_v_word_chars") + 1) / n)),
            "_v_x1": whole(F.log1p(100.0 * F.col("_v_n_symbols") / n)),
            "_v_x2": whole(F.log1p(100.0 * F.col("_v_upper") / chars)),
            "_v_x3": whole(F.log1p(100.0 * (F.col("_v_word_chars") - F.col("_v_letters")) / chars)),
        }
    ).drop("_v_t", "_v_words", "_v_lines", "_v_windows")


# ---- minimum covariance determinant --------------------------------------------------------------


def chi2_cdf(x: float, d: int) -> float:
    """Of an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(d // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1.0 - math.exp(-x / 2) * total


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x to the centre c under the Cholesky factor l of the covariance."""
    y: list[Column] = []
    for i, x in enumerate(STATS):
        rest = F.col(x) - F.col(f"{prefix}c{i}")
        for j in range(i):
            rest = rest - F.col(f"{prefix}l{i}{j}") * y[j]
        y.append(rest / F.col(f"{prefix}l{i}{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _factored(df: DataFrame) -> DataFrame:
    """Cholesky factor columns l of covariance columns v."""
    for i in range(len(STATS)):
        for j in range(i + 1):
            rest = F.col(f"v{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-3))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.drop(*[f"v{i}{j}" for i, j in _pairs()])


STARTS = 5
_DIMS = range(len(STATS))
_WHOLE = 1024


def _marks(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians q and scales s of each group: from counts of each value, which are few."""
    long = stats.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(x).alias("x")) for i, x in enumerate(STATS)])).alias("s")).select(*keys, "s.dim", "s.x")
    counts = long.groupBy(*keys, "dim", "x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys, "dim").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "dim")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("x")))
    marks = counts.groupBy(*keys, "dim").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), F.max("all").alias("n"))
    one = lambda i, c: F.max(F.when(F.col("dim") == i, c))
    return marks.groupBy(*keys).agg(F.max("n").alias("n"), *[one(i, F.col("q2").cast("double")).alias(f"q{i}") for i in _DIMS], *[one(i, (F.col("q3") - F.col("q1")) / F.lit(1.349)).alias(f"s{i}") for i in _DIMS])


def _moments(rows: DataFrame, by: list[str], xs: list[Column]) -> DataFrame:
    """Means c and covariances v of exact sums of whole numbers, by group."""
    return rows.groupBy(*by).agg(F.count("*").alias("m"), *[F.sum(x).alias(f"t{i}") for i, x in enumerate(xs)], *[F.sum(xs[i] * xs[j]).alias(f"p{i}{j}") for i, j in _pairs()])


def _covariance(df: DataFrame, floor: float) -> DataFrame:
    """Columns c and v from sums m, t and p."""
    mean = lambda i: F.col(f"t{i}") / F.col("m")
    return df.withColumns({f"c{i}": mean(i) for i in _DIMS} | {f"v{i}{j}": F.col(f"p{i}{j}") / F.col("m") - mean(i) * mean(j) + F.lit(floor if i == j else 0.0) for i, j in _pairs()})


def _starts(stats: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """The first estimates of each group: keys, start, centre c and factor l."""
    marks = written(_marks(stats, keys), "marks")
    met = with_facts(stats, marks.drop("n"), keys, list(STATS))
    spread = [F.sqrt(F.pow(F.col(f"s{i}"), F.lit(2.0)) + F.lit(floor)) for i in _DIMS]
    z = [(F.col(x) - F.col(f"q{i}")) / spread[i] for i, x in enumerate(STATS)]
    met = met.withColumns({f"z{i}": z[i] for i in _DIMS})
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in _DIMS), F.lit(1e-9)))
    whole = lambda x: F.round(F.lit(float(_WHOLE)) * x).cast("long")
    near = F.floor(32.0 * F.log2(1.0 + length * length)).cast("int")
    kinds = [
        [whole(F.tanh(f"z{i}")) for i in _DIMS],
        [whole(F.col(f"z{i}") / length) for i in _DIMS],
        [F.col(x) for x in STATS],
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("start"), *[x.cast("long").alias(f"y{i}") for i, x in enumerate(xs)]) for k, xs in enumerate(kinds)]))
    sums = _moments(met.select(*keys, near.alias("bin"), each.alias("e")).select(*keys, "bin", "e.*"), [*keys, "start", "bin"], [F.col(f"y{i}") for i in _DIMS])
    sums = written(sums, "starts")  # a row for each group, start and bin
    total = lambda df: df.groupBy(*keys, "start").agg(F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in _SUMS])
    half = total(_nearest(sums.filter("start = 3"), [*keys, "start"], 0.5)).withColumn("start", F.lit(4))
    found = _covariance(total(sums).unionByName(half), 0.0).join(marks.drop("n"), keys)
    # correlations of squashed and sphered values are scaled back to the statistics; they stand at the medians
    unit = [F.sqrt(F.greatest(F.col(f"v{i}{i}"), F.lit(1e-9))) for i in _DIMS]
    scaled = F.col("start") <= 2
    values = {f"c{i}": F.when(scaled, F.col(f"q{i}")).otherwise(F.col(f"c{i}")) for i in _DIMS}
    for i, j in _pairs():
        if i == j:
            values[f"v{i}{j}"] = F.when(scaled, F.pow(spread[i], F.lit(2.0))).otherwise(F.col(f"v{i}{j}") + F.lit(floor))
        else:
            values[f"v{i}{j}"] = F.when(scaled, F.lit(0.999) * F.col(f"v{i}{j}") / (unit[i] * unit[j]) * spread[i] * spread[j]).otherwise(F.col(f"v{i}{j}"))
    plain = marks.withColumns({"start": F.lit(0)} | {f"c{i}": F.col(f"q{i}") for i in _DIMS} | {f"v{i}{j}": F.pow(spread[i], F.lit(2.0)) if i == j else F.lit(0.0) for i, j in _pairs()})
    columns = [*keys, "start", *[f"c{i}" for i in _DIMS], *[f"v{i}{j}" for i, j in _pairs()]]
    return _factored(found.withColumns(values).select(columns).unionByName(plain.select(columns)))


_SUMS = [f"t{i}" for i in _DIMS] + [f"p{i}{j}" for i, j in _pairs()]


def _nearest(sums: DataFrame, by: list[str], share: float) -> DataFrame:
    """Of the sums by group and bin those of the nearest bins; the last one counts in part, so that the share is exact."""
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy(*by)))
    taken = F.least(F.lit(1.0), (F.ceil(F.lit(share) * F.col("n")) - F.col("before")) / F.col("m"))
    return sums.withColumn("_w", taken).filter("_w > 0").withColumns({c: F.col("_w") * F.col(c) for c in ("m", *_SUMS)}).drop("_w", "before")


def _concentrate(stats: DataFrame, estimate: DataFrame, keys: list[str], share: float, floor: float) -> DataFrame:
    """One concentration step from all starts: centre, factor and (log) determinant of the nearest ``share``."""
    cells = F.collect_list(F.struct(*[c for c in estimate.columns if c not in keys]))
    packed = written(estimate.groupBy(*keys).agg(cells.alias("_e")), "packed")  # at most STARTS in each
    met = with_facts(stats, packed, keys, list(STATS)).select(*keys, *STATS, F.explode("_e").alias("_e")).select(*keys, *STATS, "_e.*")
    binned = met.withColumn("bin", F.floor(32.0 * F.log2(1.0 + _distance())).cast("int"))
    by = [*keys, "start"]
    near = _nearest(_moments(binned, [*by, "bin"], [F.col(x) for x in STATS]), by, share)
    near = near.groupBy(*by).agg(F.max("n").alias("n"), F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in _SUMS])
    out = _factored(_covariance(near, floor).select(*by, "n", *[f"c{i}" for i in _DIMS], *[f"v{i}{j}" for i, j in _pairs()]))
    return out.withColumn("det", F.round(2 * sum((F.log(f"l{i}{i}") for i in _DIMS), F.lit(0.0)), 9))


def estimates(stats: DataFrame, keys: list[str], share: float = 0.75, steps: int = 8, floor: float = (UNIT / 8) ** 2) -> DataFrame:
    """Centre (c), Cholesky factor (l) and log determinant (det) of each group, and its number of rows n.

    The first two steps go on from every start, further ones from the two of the least determinant."""
    now, best, last = _starts(stats, keys, floor), None, None
    for step in range(steps):
        now = _concentrate(stats, now, keys, share, floor)
        if step == 1:
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy("det", "start"))
            now = now.withColumn("_nth", nth).filter("_nth <= 2").drop("_nth")
        now = written(now, "estimates")
        every = now if best is None else best.unionByName(now)
        first = F.row_number().over(Window.partitionBy(*keys).orderBy("det", "start"))
        best = written(every.withColumn("_nth", first).filter("_nth = 1").drop("_nth"), "best")
        total = best.agg(F.sum(F.col("det").cast("decimal(38,9)")), F.count("*")).first()
        if step >= 2 and total == last:
            break
        last = total
    return best


def judged(docs: DataFrame, keys: tuple[str, str] = ("lang", "source"), text_col: str = "text", share: float = 0.75, steps: int = 8, far: float = 1 - 1e-9, least: int = 50) -> DataFrame:
    """Base counts, base_failed, distance (robust, squared; null without an estimate) and kept, with the
    columns of ``docs`` but the text."""
    own = [c for c in docs.columns if c != text_col]
    names = [f"_v_{k}" for k in keys]
    told = counted(docs.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, keys)}), text_col).drop(text_col)
    failed = (F.col("_v_n_words") < 20) | (100 * F.col("_v_n_repeat_words") > 30 * F.col("_v_n_words"))
    told = written(told.withColumn("_v_base_failed", failed).withColumn("_v_row", F.monotonically_increasing_id()), "statistics")
    # sources with few texts are pooled by language, languages with few pooled texts with each other
    sizes = told.groupBy(*names).agg(F.count_if(~F.col("_v_base_failed")).alias("_n"))
    enough = F.col("_n") >= least
    pool = F.sum(F.when(enough, 0).otherwise(F.col("_n"))).over(Window.partitionBy(names[0]))
    group = F.when(enough, F.concat(F.lit("s="), F.col(names[0]), F.lit("\n"), F.col(names[1]))).when(pool >= least, F.concat(F.lit("l="), F.col(names[0]))).otherwise("all")
    groups = written(sizes.select(*names, group.alias("_v_group")), "groups")
    told = written(with_facts(told, groups, names, ["_v_row"]).drop(*names), "statistics")
    bulk = told.filter(~F.col("_v_base_failed")).select("_v_group", *STATS)
    inside = chi2_cdf(chi2_quantile(share, len(STATS)), len(STATS) + 2)
    bulks = estimates(bulk, ["_v_group"], share, steps)
    bulks = bulks.select("_v_group", F.struct(*[c for c in bulks.columns if c != "_v_group"]).alias("_v_e"))
    # groups of failed texts only have no estimate
    every = written(groups.select("_v_group").distinct().join(bulks, "_v_group", "left"), "bulks")
    found = with_facts(told, every, ["_v_group"], ["_v_row"])
    found = found.withColumns({f"_v_{c}": F.col(f"_v_e.{c}") for c in ["n", *[f"c{i}" for i in _DIMS], *[f"l{i}{j}" for i, j in _pairs()]]})
    found = found.withColumn("_v_distance", F.when(F.col("_v_n") >= least, _distance("_v_") * F.lit(inside / share)))
    within = F.coalesce(F.col("_v_distance") <= chi2_quantile(far, len(STATS)), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [c for c in own if c not in (*counts, "base_failed", "kept", "distance")]
    return found.select(*own, *[F.col(f"_v_{c}").alias(c) for c in counts], F.col("_v_base_failed").alias("base_failed"), (~F.col("_v_base_failed") & within).alias("kept"), F.round("_v_distance", 3).alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_quality_rules``: which documents are kept, by language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
