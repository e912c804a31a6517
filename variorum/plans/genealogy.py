"""Families from the collation: the tree, who belongs where, and how far to trust it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coherence as C
from ..operators import statistics as S
from ..operators import trees
from ..schema import Collation, written
from . import metrics as M

# Published memberships.
F1 = ["1", "22", "118", "138", "209", "357", "565", "884", "994", "1192", "1210", "1278", "1582", "2193", "2372", "2575", "2713", "2886"]
F13 = ["13", "69", "124", "346", "543", "788", "826", "828", "983", "1689"]
ALEXANDRIAN = ["P66", "P75", "01", "03", "019", "04", "032"]
F1_CORE = ["1", "1582", "118", "209"]
F13_CORE = ["13", "69", "124", "346", "543", "788", "826", "828", "983"]
KNOWN = {"f1": ("iohannes_list", F1), "f13": ("iohannes_list", F13), "Alexandrian": ("manual", ALEXANDRIAN)}
CORES = {"f1": F1_CORE, "f13": F13_CORE}
SUPPORT = {"f1_core": F1_CORE, "f13": F13, "f1_full": F1}


@dataclass(frozen=True)
class Genealogy:
    """The informative matrix, its pair table and the tree, computed once for all that follows."""

    matrix: DataFrame
    pairs: DataFrame
    tree: trees.Linkage
    distance: np.ndarray


def build(matrix: DataFrame, settings) -> Genealogy:
    """``matrix``: a long reading matrix (app_id, base_ga, reading_id).

    The matrix, its informative part and the pairs are written once, as all that follows uses them."""
    matrix = written(matrix, "matrix")
    units = C.informative_units(matrix, settings.min_extant, settings.max_modal)
    told = written(matrix.join(units.select("app_id"), "app_id", "left_semi"), "informative")
    pairs = written(C.distances(told, settings.min_overlap), "pairs").cache()
    names, distance = trees.matrix(pairs)
    return Genealogy(told, pairs, trees.average_linkage(names, distance), distance)


def clusters(g: Genealogy, k: int) -> DataFrame:
    """(base_ga, cluster) at the cut into at most k."""
    spark = g.pairs.sparkSession
    return spark.createDataFrame([(w, int(n)) for w, n in zip(g.tree.names, g.tree.cut(k))], "base_ga string, cluster int")


def largest_cluster(assigned: DataFrame) -> DataFrame:
    """Witnesses of the largest cluster, the one of the least number on a tie."""
    top = assigned.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(1).select("cluster")
    return assigned.join(F.broadcast(top), "cluster", "left_semi")  # one row


def families(g: Genealogy, k: int, known: dict = KNOWN) -> DataFrame:
    """(base_ga, family, family_source, weight)."""
    assigned = clusters(g, k)
    out = M.assign_families(assigned, known, largest_cluster(assigned))
    out = out.withColumn("family_source", F.when(F.col("family_source").isin("cluster", "unassigned"), "computed").otherwise(F.col("family_source")))
    return M.witness_weights(out)


def ground_truth(witnesses: DataFrame, bundle: DataFrame | None = None, known: dict = KNOWN) -> DataFrame:
    """(base_ga, family) by published lists, then by the Byzantine bundle; others have no label."""
    empty = witnesses.sparkSession.createDataFrame([], "base_ga string")
    return M.assign_families(witnesses, known, bundle if bundle is not None else empty).filter("family != 'other'").select("base_ga", "family")


def _draws(seed: int, rep: int, n: int) -> np.ndarray:
    """How often each of n units is drawn in a resampling."""
    return np.bincount(np.random.default_rng([seed, rep]).integers(0, n, n), minlength=n).astype(np.uint8)


def bootstrap_support(g: Genealogy | DataFrame, members: dict[str, list[str]], b: int, seed: int, min_overlap: int = 100, compact: float = 0.12, spread: int = 64) -> DataFrame:
    """(family, support): in how many resamplings of the informative units (of a genealogy, or of its matrix) the
    family forms a clade.

    A pair of witnesses is counted in one task for all replicates, from arrays of the units' witnesses; pairs that
    can't share ``min_overlap`` units in any replicate, by the most draws of each of their units, are done at once.
    Only links (pairs nearer than 1) are shuffled, by replicate, and each replicate's tree is made from them in a task."""
    matrix = g.matrix if isinstance(g, Genealogy) else g
    spark = matrix.sparkSession
    told, who = C.cells(matrix)
    units = written(S.numbered(told, "app_id", "k"), "units")
    tails = C.tails(told.join(units, "app_id").select("app_id", "i", "code", "k"), "k")
    n_units, names = units.count(), [r["base_ga"] for r in who.orderBy("i").toLocalIterator()]
    if not n_units or not b:
        return spark.createDataFrame([], "family string, support double")
    at = {w: i for i, w in enumerate(names)}
    present = {f: [at[w] for w in set(m) if w in at] for f, m in members.items()}
    parts = min(b, spread)
    most = spark.sparkContext.parallelize(range(b), parts).mapPartitions(lambda reps: _most(seed, reps, n_units)).treeReduce(np.maximum)
    shared = spark.sparkContext.broadcast(most)

    def count(batches):
        draws = None
        for i, k, t in _by_witness(batches):
            key, same = i * len(names) + (t >> 1), (t & 1).astype(bool)
            pair, place = np.unique(key, return_inverse=True)
            can = np.bincount(place, shared.value[k], len(pair)) >= min_overlap
            can &= pair // len(names) != pair % len(names)
            if not can.any():
                continue
            if draws is None:
                draws = [_draws(seed, rep, n_units) for rep in range(b)]
            own = can[place]
            number = np.cumsum(can) - 1
            place, k, same, pair = number[place[own]], k[own], same[own], pair[can]
            for rep, drawn in enumerate(draws):
                times = drawn[k]
                overlap = np.bincount(place, times, len(pair))
                agree = np.bincount(place[same], times[same], len(pair))
                at = np.flatnonzero((overlap >= min_overlap) & (agree > 0))
                if len(at):
                    yield _link_batch(rep, pair[at] // len(names), pair[at] % len(names), 1.0 - agree[at] / overlap[at])

    found = tails.select("i", "k", "t").sortWithinPartitions("i").mapInArrow(count, "rep int, i int, j int, distance double")
    every = spark.range(b).select(F.col("id").cast("int").alias("rep"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(1.0).alias("distance"))  # replicates without links are there, too
    told_names = spark.sparkContext.broadcast((names, present))

    def tree(key, rows):
        import pandas as pd

        names, present = told_names.value
        rows = rows[rows["i"] >= 0].sort_values(["i", "j"])
        made = trees.average_linkage_of(trees.Links(names, rows["i"].to_numpy(), rows["j"].to_numpy(), rows["distance"].to_numpy()))
        return pd.DataFrame([(f, int(trees.recovered_at(made, set(m), compact))) for f, m in present.items()], columns=["family", "hit"])

    reps = found.union(every).groupBy("rep").applyInPandas(tree, "family string, hit int")
    return reps.groupBy("family").agg(F.round(F.avg(F.col("hit").cast("double")), 3).alias("support"))


def _most(seed: int, reps: Iterator[int], n: int) -> Iterator[np.ndarray]:
    most = np.zeros(n, np.uint8)
    for rep in reps:
        np.maximum(most, _draws(seed, rep, n), out=most)
    yield most


#: Numbers of pairs that are counted at a time (a witness with more is counted as one).
AT_ONCE = 2_000_000


def _by_witness(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, k, t) flat, of whole witnesses, from batches in order of i."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, last = 0, None

    def flat():
        return tuple(np.concatenate(x) for x in zip(*held))

    for batch in batches:
        i, k, t = batch.columns
        ids, lengths = i.to_numpy(), pc.list_value_length(t).to_numpy()
        values, ends = t.flatten().to_numpy(), np.cumsum(lengths)
        cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] if last is None else last)) if len(ids) else []
        start = 0
        for stop in (*cuts, len(ids)):
            if stop > start:
                lo, hi = (ends[start - 1] if start else 0), ends[stop - 1]
                part = lengths[start:stop]
                new = (np.repeat(ids[start:stop].astype(np.int64), part), np.repeat(k.to_numpy()[start:stop].astype(np.int64), part), values[lo:hi].astype(np.int64))
                if held and size >= AT_ONCE and ids[start] != last:
                    yield flat()
                    held, size = [], 0
                held.append(new)
                size, last, start = size + int(hi - lo), ids[stop - 1], stop
    if held:
        yield flat()


def _link_batch(rep: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), rep, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(distance)], ["rep", "i", "j", "distance"])


def sensitivity(matrix: DataFrame, settings, modal=(0.85, 0.90, 0.95), overlaps=(50, 100, 200), members: dict[str, list[str]] | None = None) -> list[dict]:
    """Are the families recovered at other thresholds?  Pair counts are made once for each modal share."""
    out = []
    for share in modal:
        units = C.informative_units(matrix, settings.min_extant, share)
        counts = C.distances(matrix.join(units.select("app_id"), "app_id", "left_semi"), 0).cache()
        n = units.count()
        for least in overlaps:
            pairs = counts.withColumn("distance", F.when(F.col("overlap") < least, 1.0).otherwise(F.coalesce("distance", F.lit(1.0))))
            tree = trees.average_linkage(*trees.matrix(pairs))
            out.append({"max_modal": share, "min_overlap": least, "n_units": n} | {f: trees.recovered(tree, m, settings.clade_compactness) for f, m in (members or {"f1": F1_CORE, "f13": F13}).items()})
        counts.unpersist()
    return out


def cut_sweep(g: Genealogy, truth: DataFrame, settings) -> dict:
    """Rand index and V-measure at the deployed cut, and the best cut of a sweep (for description only)."""
    labels = {r["base_ga"]: r["family"] for r in truth.collect()}  # labelled witnesses
    spark = g.pairs.sparkSession
    rows = [(k, labels[w], int(c)) for k in range(4, settings.validation_k_max + 1) for w, c in zip(g.tree.names, g.tree.cut(k)) if w in labels]
    frame = spark.createDataFrame(rows, "k int, t string, p int")

    def at(k: int) -> tuple[float, float]:
        own = frame.filter(F.col("k") == k)
        return C.adjusted_rand(own, "t", "p").first()["ari"], C.v_measure(own, "t", "p").first()["v_measure"]

    best, k_best = -1.0, None
    for k in range(4, settings.validation_k_max + 1):
        ari = at(k)[0]
        if ari > best:
            best, k_best = ari, k
    ari, v = at(settings.n_clusters)
    return {"ari": round(ari, 3), "v_measure": round(v, 3), "k": settings.n_clusters, "best_ari_sweep": {"ari": round(best, 3), "k": k_best}}


def validate(g: Genealogy, matrix: DataFrame, truth: DataFrame, settings, b: int | None = None, known_pairs: dict[str, int] | None = None) -> dict:
    """Silhouettes, clade support, neighbours, cuts and sensitivity, with the overall verdict."""
    sil = {r["family"]: r["silhouette"] for r in C.silhouette(g.pairs, truth).collect()}
    overall = sil.pop("overall", None)
    byz = [r["base_ga"] for r in truth.filter("family = 'Byz'").collect()]
    support = {r["family"]: r["support"] for r in bootstrap_support(g, SUPPORT | {"Byz": byz}, b or settings.genealogy_bootstrap, settings.seed, settings.min_overlap, settings.clade_compactness).collect()}
    sens = sensitivity(matrix, settings)
    near = C.nearest(g.pairs, 3)
    pairs = {w: [(r["w2"], round(r["distance"], 3)) for r in near.filter((F.col("w1") == w) & (F.col("nth") <= k)).orderBy("nth").collect()] for w, k in (known_pairs or {"1": 1, "13": 1, "P75": 2}).items()}
    passed = bool(sil) and all(s > 0 for s in sil.values()) and support["f1_core"] >= 0.7 and support["f13"] >= 0.7 and all(r["f1"] and r["f13"] for r in sens)
    return {"n_witnesses": len(g.tree.names), "n_labeled": truth.count(), "silhouette": {"by_family": sil, "overall": overall}, "bootstrap_support": support, "known_pairs": pairs, "cluster_match": cut_sweep(g, truth, settings), "sensitivity": sens, "passed": passed}


def validation_report(found: dict) -> dict[str, object]:
    """The parts of the validation as a report has them."""
    near = [{"witness": w, "nearest": ", ".join(f"{o} ({d})" for o, d in rows)} for w, rows in found["known_pairs"].items()]
    cut = found["cluster_match"]
    return {
        "Verdict": {"passed": found["passed"], "witnesses": found["n_witnesses"], "labelled": found["n_labeled"]},
        "Silhouettes": found["silhouette"]["by_family"] | {"overall": found["silhouette"]["overall"]},
        "Clade support": found["bootstrap_support"],
        "Nearest neighbours": near,
        "Cuts": {"clusters": cut["k"], "ari": cut["ari"], "v_measure": cut["v_measure"], "best ari of the sweep (described, not tested)": cut["best_ari_sweep"]},
        "Sensitivity": found["sensitivity"],
    }


def from_collation(c: Collation) -> Genealogy:
    return build(C.reading_matrix(c), c.settings)
