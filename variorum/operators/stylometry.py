"""Stylometry: token windows, most frequent words, Burrows's Delta, section tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

#: Most windows of a section test: 2,000 windows are 32 MB of distances.
MOST_WINDOWS = 2_000


def tokens(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book",), order: str = "doc_id") -> DataFrame:
    """(keys, order, pos, lemma): lower-cased words of texts in order."""
    return docs.select(*keys, order, F.posexplode(words(F.lower(F.col(text)))).alias("pos", "lemma"))


def positions(docs: DataFrame, keys: tuple[str, ...], order: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their words, ``base``: how many words of their key stand in earlier documents, and
    ``total``: how many words their key has.  Null keys are a key, a null order comes first, rows that are equal
    in all of these follow each other.

    The running sum goes over one number a document, not over the words; rows are told apart by a digest."""
    one = F.struct(*keys, order, text)
    said = F.coalesce(F.col(text), F.lit(""))
    listed = docs.select(*keys, order, said.alias("_t"), F.md5(F.to_json(one, {"ignoreNullFields": "false"})).alias("_row"))
    split = words(F.lower(F.col("_t")))
    sizes = listed.select(*keys, order, "_row", F.size(split).cast("long").alias("n")).groupBy(*keys, order, "_row", "n").agg(F.count("*").alias("copies"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(F.asc_nulls_first(order), "_row").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("n") * F.col("copies")
    sizes = sizes.withColumn("base", F.coalesce(F.sum(own).over(before), F.lit(0).cast("long"))).withColumn("total", F.sum(own).over(whole))
    each = sizes.select("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_k"), "base", "n", "total")
    each = each.select("_row", (F.col("base") + F.col("_k") * F.col("n")).alias("base"), "total")
    # texts are shuffled, not their words
    return listed.dropDuplicates(["_row"]).join(each, "_row").withColumn("_w", split).drop("_row", "_t")


def token_windows(docs: DataFrame, keys: tuple[str, ...], w: int = 200, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(keys, window, pos, lemma): consecutive windows of w words of each key; a last one of 3/4 w or more stays."""
    words_ = F.posexplode("words").alias("_k", "lemma")
    return window_pieces(docs, keys, w, order, text).select(*keys, "window", "start", words_).select(*keys, "window", (F.col("start") + F.col("_k")).alias("pos"), "lemma")


def window_pieces(docs: DataFrame, keys: tuple[str, ...], w: int = 200, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(keys, window, start, words): the same windows in pieces, each the part of one document from place ``start``."""
    placed = positions(docs, keys, order, text).filter(F.size("_w") > 0)
    last = F.floor((F.col("base") + F.size("_w") - 1) / w).cast("long")
    each = placed.select(*keys, "base", "total", "_w", F.explode(F.sequence(F.floor(F.col("base") / w).cast("long"), last)).alias("window"))
    size = F.least(F.lit(w), F.col("total") - F.col("window") * w)
    skipped = F.greatest(F.col("window") * w - F.col("base"), F.lit(0).cast("long"))  # words of earlier windows
    start = (F.col("base") + skipped - F.col("window") * w).cast("int")
    part = F.slice("_w", skipped.cast("int") + 1, F.lit(w) - start)
    return each.filter(size >= 0.75 * w).select(*keys, "window", start.alias("start"), part.alias("words"))


def window_figures(pieces: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, window, n, n_types, first_type, opens) of windows in pieces, which are reduced before they are shuffled."""
    own = pieces.select(*keys, "window", F.size("words").alias("n"), F.array_distinct("words").alias("_t"), F.array_min("words").alias("_first"), F.when(F.col("start") == 0, F.get("words", F.lit(0))).alias("_opens"))
    types = F.size(F.array_distinct(F.flatten(F.collect_list("_t")))).cast("long")
    return own.groupBy(*keys, "window").agg(F.sum("n").alias("n"), types.alias("n_types"), F.min("_first").alias("first_type"), F.max("_opens").alias("opens"))


def most_frequent(rows: DataFrame, k: int = 100, word: str = "lemma") -> DataFrame:
    """(lemma, n, nth): the k most frequent words, ties by the word."""
    top = rows.groupBy(word).agg(F.count("*").alias("n")).orderBy(F.desc("n"), word).limit(k)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n"), word)))  # k rows


def z_table(rows: DataFrame, sample: str = "sample", k: int = 100, word: str = "lemma") -> DataFrame:
    """(sample, lemma, z) over the most frequent words: standardised relative frequencies (a word of equal
    frequency everywhere has z 0)."""
    counts = rows.groupBy(sample, word).agg(F.count("*").alias("c"))
    totals = counts.groupBy(sample).agg(F.sum("c").alias("total"))
    mfw = most_frequent(rows, k, word).select(word)
    spine = totals.crossJoin(F.broadcast(mfw))  # k words
    freq = spine.join(counts, [sample, word], "left").select(sample, word, (F.coalesce("c", F.lit(0).cast("long")) / F.col("total")).alias("f"))
    spread = freq.groupBy(word).agg(F.avg("f").alias("mu"), F.stddev_pop("f").alias("sd"))
    return freq.join(F.broadcast(spread), word).select(sample, word, ((F.col("f") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("z"))


def delta_pairs(z: DataFrame, sample: str = "sample", word: str = "lemma") -> DataFrame:
    """(s1, s2, delta) of all pairs of samples, s1 < s2: the mean absolute difference of z.

    A sample is one row with an array of k numbers, so pairs are of samples, not of words."""
    one = z.groupBy(sample).agg(F.transform(F.sort_array(F.collect_list(F.struct(word, "z"))), lambda x: x["z"]).alias("v"))
    a, b = one.select(F.col(sample).alias("s1"), F.col("v").alias("v1")), one.select(F.col(sample).alias("s2"), F.col("v").alias("v2"))
    apart = F.aggregate(F.zip_with("v1", "v2", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("v1")
    return a.join(b, F.col("s1") < F.col("s2")).select("s1", "s2", apart.alias("delta"))


def separation(pairs: DataFrame, authors: DataFrame) -> DataFrame:
    """(same_author, diff_author, ratio): mean Delta of pairs of one and of two authors."""
    met = pairs.join(authors.select(F.col("sample").alias("s1"), F.col("author").alias("a1")), "s1").join(authors.select(F.col("sample").alias("s2"), F.col("author").alias("a2")), "s2")
    same = F.col("a1") == F.col("a2")
    out = met.agg(F.avg(F.when(same, F.col("delta"))).alias("same_author"), F.avg(F.when(~same, F.col("delta"))).alias("diff_author"))
    return out.withColumn("ratio", F.col("diff_author") / F.nullif(F.col("same_author"), F.lit(0.0)))


def section_gaps(pairs: DataFrame, roles: DataFrame, body: str = "body") -> DataFrame:
    """(section, gap, band, diff, label): mean Delta of each section to the body, and how it reads.

    band: the body's own mean and two standard deviations; diff: the mean of controls of two authors."""
    met = pairs.join(roles.select(F.col("sample").alias("s1"), F.col("role").alias("r1"), F.col("author").alias("a1")), "s1")
    met = met.join(roles.select(F.col("sample").alias("s2"), F.col("role").alias("r2"), F.col("author").alias("a2")), "s2")
    own = (F.col("r1") == body) & (F.col("r2") == body)
    control = (F.col("r1") == "control") & (F.col("r2") == "control") & (F.col("a1") != F.col("a2"))
    marks = met.agg((F.avg(F.when(own, F.col("delta"))) + 2 * F.stddev_pop(F.when(own, F.col("delta")))).alias("band"), F.avg(F.when(control, F.col("delta"))).alias("diff"))
    cross = met.filter(((F.col("r1") == body) != (F.col("r2") == body)) & (F.col("r1") != "control") & (F.col("r2") != "control"))
    gaps = cross.groupBy(F.when(F.col("r1") == body, F.col("r2")).otherwise(F.col("r1")).alias("section")).agg(F.avg("delta").alias("gap"))
    label = F.when(F.col("gap") <= F.col("band"), "within body range").when(F.col("gap") >= F.col("diff"), "approaches different authors").otherwise("elevated, below different authors")
    return gaps.crossJoin(F.broadcast(marks)).withColumn("label", label)


def section_permutation(pairs: DataFrame, roles: DataFrame, sections: list[str], n_perm: int, seed: int, body: str = "body", chunk: int = 250) -> DataFrame:
    """(section, obs, p, n_windows): is a section farther from the body than body windows from each other?

    The Delta table of one book's windows goes to the driver and is broadcast (at most ``MOST_WINDOWS`` windows,
    checked); replicates are dealt over tasks in chunks."""
    spark = pairs.sparkSession
    asked = roles.filter(F.col("role").isin(body, *sections)).select("sample", "role")
    if (n := asked.count()) > MOST_WINDOWS:
        raise ValueError(f"{n} windows are more than a test of one book takes ({MOST_WINDOWS})")
    r = asked.orderBy("sample").toPandas()
    at = {s: i for i, s in enumerate(r["sample"])}
    rows = pairs.join(asked.select(F.col("sample").alias("s1")), "s1", "left_semi").join(asked.select(F.col("sample").alias("s2")), "s2", "left_semi").toPandas()
    d = np.zeros((len(at), len(at)))
    i, j = rows["s1"].map(at).to_numpy(int), rows["s2"].map(at).to_numpy(int)
    d[i, j] = d[j, i] = rows["delta"].to_numpy(float)
    role = r["role"].to_numpy()
    shared = spark.sparkContext.broadcast((d, role))
    todo = [(s, k, min(chunk, n_perm - k)) for s in sections if (role == s).any() and (role == body).sum() >= 2 for k in range(0, n_perm, chunk)]
    schema = "section string, obs double, hits long, n long, n_windows int"
    if not todo:
        return spark.createDataFrame([], "section string, obs double, p double, n_windows int")

    def run(batches):
        import pandas as pd

        d, role = shared.value
        for batch in batches:
            out = []
            for section, first, n in zip(batch["section"], batch["first"], batch["n"]):
                own, rest = np.flatnonzero(role == section), np.flatnonzero(role == body)
                pool, k = np.concatenate([rest, own]), len(own)
                obs = d[np.ix_(own, rest)].mean()
                rng = np.random.default_rng([seed, sections.index(section), int(first)])
                hits = sum(d[np.ix_(p[:k], p[k:])].mean() >= obs - 1e-12 for p in (rng.permutation(pool) for _ in range(n)))
                out.append((section, float(obs), int(hits), int(n), k))
            yield pd.DataFrame(out, columns=["section", "obs", "hits", "n", "n_windows"])

    work = spark.createDataFrame(todo, "section string, first long, n long").repartition(len(todo))
    each = work.mapInPandas(run, schema)
    return each.groupBy("section").agg(F.max("obs").alias("obs"), ((F.sum("hits") + 1) / (F.sum("n") + 1)).alias("p"), F.max("n_windows").alias("n_windows"))
