"""Inferential stages: confounds of instability, robustness, known phenomena, style, and release gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regression as R
from ..operators import statistics as S
from ..operators import stylometry as Y
from ..schema import Collation
from . import metrics as M

CONTROLS = ["coverage_z", "verse_length_z", "n_lectionaries_z", "n_families_z"]
SECTIONS = ["appendix", "farewell", "prologue"]


def _coded(c: Collation) -> tuple[DataFrame, list[str]]:
    """Standardised covariates with section dummies, for those sections that occur."""
    rows = M.standardised_covariates(c).fillna(0.0, subset=CONTROLS).cache()
    there = {r["section"] for r in rows.select("section").distinct().collect()}  # four at most
    coded, names = R.dummies(rows, "section", "body", [s for s in SECTIONS if s in there])
    return coded, names


def confounds(c: Collation, dv: str = "between_family_split") -> dict:
    """Does the section matter beyond coverage, length, lectionaries, families and Synoptic parallels?"""
    rows, sections = _coded(c)
    terms = [*CONTROLS, "synoptic", *sections]
    full, reduced = R.ols_hc3(rows, dv, terms), R.ols_hc3(rows, dv, [*CONTROLS, "synoptic"])
    spark = c.spark
    table = spark.createDataFrame([(t, float(b), float(p)) for t, b, p in zip(full.terms[1:], full.coef[1:], full.p[1:])], "term string, coef double, p double")
    table = S.benjamini_hochberg(table)
    stat, p = full.wald(sections) if sections else (0.0, 1.0)
    glm = R.fractional_logit(rows, dv, terms, "n_units_fam")
    focal = ["synoptic", *sections]
    return {
        "dv": dv, "n": full.n, "r2_full": round(full.r2, 4), "r2_reduced": round(reduced.r2, 4), "coefficients": table, "section_wald": round(stat, 3), "section_p": p,
        "vif": {k: round(v, 2) for k, v in R.vif(rows, [*CONTROLS, "synoptic"]).items()},
        "glm": {t: {"coef": round(float(glm.coef[glm.terms.index(t)]), 4), "p": round(float(glm.p[glm.terms.index(t)]), 4)} for t in focal},
    }


def robustness(c: Collation, b: int | None = None, families: tuple[str, ...] = M.FAMILIES, low: int = 21, high: int = 19) -> dict:
    """Bootstrap intervals of chapters, leave-one-family-out correlation, cluster bootstrap of coefficients."""
    b = b or c.settings.robustness_bootstrap
    vote = M.family_vote(c).withColumn("bfs", F.col("between_family_split").cast("double"))
    ci = S.bootstrap_intervals(vote, "app_id", "chapter", ["family_instability", "bfs"], b, c.settings.seed)
    loo = {r["dropped"]: r["rho"] for r in M.spearman_leave_one_out(c, families).collect()}
    by = vote.groupBy("chapter").agg(F.avg("family_instability").alias("family_instability"))
    thirds = M.chapter_thirds(by, "family_instability", low, high).first()
    rows, sections = _coded(c)
    terms = [*CONTROLS, "synoptic", *sections]
    draws = R.cluster_bootstrap(rows, "between_family_split", terms, "chapter", b, c.settings.seed)
    interval = lambda t: tuple(np.percentile(draws[:, 1 + terms.index(t)], [2.5, 97.5]).round(4).tolist()) if t in terms else (float("nan"),) * 2
    prologue, synoptic = interval("section[prologue]"), interval("synoptic")
    known = [x for x in loo.values() if x is not None]
    conf = {"prologue_ci": prologue, "prologue_robust_negative": prologue[1] < 0, "synoptic_ci": synoptic, "synoptic_robust_positive": synoptic[0] > 0}
    least = min(known) if known else None
    verdict = least is not None and least >= 0.8 and bool(thirds["low_stays_low"]) and conf["prologue_robust_negative"] and conf["synoptic_robust_positive"]
    return {"B": b, "chapter_ci": ci, "leave_one_family_out": loo, "min_spearman": least, "low_stays_low": thirds["low_stays_low"], "high_stays_high": thirds["high_stays_high"], "confounds": conf, "all_robust": verdict}


def interpolation_gate(c: Collation, n_perm: int | None = None) -> dict:
    """Known additions must have lower coverage than their surroundings; only the pericope decides."""
    s = c.settings
    verses = M.verse_metrics(c).select("chapter", "verse", "verse_id", "extant_base_ms").cache()
    out: dict = {}
    for label, ids in (("pericope_adulterae", s.pericope), ("known_interpolations", s.interpolations)):
        there = [r["verse_id"] for r in verses.filter(F.col("verse_id").isin(*ids)).select("verse_id").collect()]
        if not there:
            out[label] = {"skipped": "no verses present"}
            continue
        r = S.block_permutation(verses, "extant_base_ms", there).first().asDict()
        r["p_value_iid"] = S.iid_permutation(verses, "extant_base_ms", there, n_perm or s.n_permutations, s.seed).first()["p_value"]
        r |= {"null": "block" if len(there) > 1 else "iid", "direction_lower": r["difference"] < 0, "passed": r["difference"] < 0 and r["p_value"] < s.alpha}
        out[label] = r
    out["gate_passed"] = bool(out["pericope_adulterae"].get("passed"))
    verses.unpersist()
    return out


def date_signal(c: Collation, verse_id: str = "B04K5V4", neighbours: tuple[str, ...] = ("B04K5V3", "B04K5V5"), n_perm: int | None = None) -> dict:
    """Are the witnesses that omit a passage earlier than those that have it?"""
    s = c.settings
    dated = c.witnesses.filter(F.col("date_mid").isNotNull()).select("base_ga", "date_mid", "date_late")
    rows = M.includers_omitters(c, verse_id, list(neighbours)).join(dated, "base_ga").cache()
    n = {r["role"]: (r["n"], r["m"]) for r in rows.groupBy("role").agg(F.count("*").alias("n"), F.median("date_mid").alias("m")).collect()}
    if any(n.get(r, (0, 0))[0] < 3 for r in ("omitter", "includer")):
        return {"skipped": "too few dated witnesses", "n_omit": n.get("omitter", (0,))[0], "n_incl": n.get("includer", (0,))[0]}
    test = lambda v: S.median_permutation(rows, v, "role", "omitter", "includer", n_perm or s.n_permutations, s.seed, "base_ga").first()
    mid, late = test("date_mid"), test("date_late")
    u = S.mann_whitney(rows, "date_mid", "role", "omitter", "includer").first()
    # as is usual: exact for small samples without ties, else by normal tails
    small = u["ties"] == 0 and min(u["n1"], u["n2"]) <= 8 and u["n1"] * u["n2"] <= 100_000
    p_less = S.exact_mann_whitney(u["u"], u["n1"], u["n2"]) if small else u["p_less"]
    return {
        "n_omit": n["omitter"][0], "n_incl": n["includer"][0], "median_omitter_date": n["omitter"][1], "median_includer_date": n["includer"][1], "difference_years": mid["difference"],
        "omitters_earlier": mid["difference"] < 0, "p_value": mid["p_value"], "mannwhitney_p": p_less, "p_value_latest_date": late["p_value"],
    }


class GateError(RuntimeError):
    """A known phenomenon wasn't recovered: nothing is published."""


def release_gates(interpolation: dict, dates: dict, monophyly: dict, alpha: float) -> None:
    """Raise unless the pericope, the date signal and the families were recovered."""
    gates = {
        "pericope": interpolation.get("gate_passed", False),
        "dates": bool(dates.get("omitters_earlier")) and (dates.get("p_value") or 1.0) < alpha,
        "family_recovery": bool(monophyly.get("all_passed")),
    }
    failed = [k for k, v in gates.items() if not v]
    if failed:
        raise GateError("release gates failed: " + ", ".join(failed))


def sections_of(lemmas: DataFrame) -> DataFrame:
    """Lemmas with their section: prologue, farewell, ch21 or body (which is what remains, in order)."""
    name = F.when((F.col("chapter") == 1) & (F.col("verse") <= 18), "prologue").when(F.col("chapter").between(13, 17), "farewell").when(F.col("chapter") == 21, "ch21").otherwise("body")
    return lemmas.withColumn("section", name)


def style(books: dict[str, tuple[str, DataFrame]], target: str, settings, n_perm: int | None = None) -> dict:
    """Delta of a book's sections against its body, with controls.

    ``books``: name -> (author, lemmas (line, chapter, verse, lemma)); ``target`` is the book with sections."""
    w = settings.window
    parts = []
    for name, (author, lemmas) in books.items():
        rows = sections_of(lemmas) if name == target else lemmas.withColumn("section", F.lit("control"))
        docs = rows.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "lemma"))), lambda x: x["lemma"]), " ").alias("text"))
        parts.append(docs.select(F.lit(name).alias("book"), F.lit(author).alias("author"), "section", F.concat_ws(":", F.lit(name), "section").alias("doc"), "text"))
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    windows = Y.token_windows(docs, ("book", "author", "section"), w, order="doc").withColumn("sample", F.concat_ws("#", "book", "section", "window")).cache()
    roles = windows.select("sample", "author", F.col("section").alias("role")).distinct().cache()
    pairs = Y.delta_pairs(Y.z_table(windows.select("sample", "lemma"), k=settings.n_mfw)).cache()
    tests = S.benjamini_hochberg(Y.section_permutation(pairs, roles, ["ch21", "farewell", "prologue"], n_perm or settings.stylometry_permutations, settings.seed))
    halves = docs.select("book", "author", "doc", F.split("text", " ").alias("v")).withColumn("v", F.col("v"))
    whole = halves.groupBy("book", "author").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("doc", "v"))), lambda x: x["v"])).alias("v"))
    m = F.floor(F.size("v") / 2).cast("int")
    half = whole.select("book", "author", F.explode(F.array(F.struct(F.lit("a").alias("h"), F.slice("v", F.lit(1), m).alias("v")), F.struct(F.lit("b").alias("h"), F.slice("v", m + 1, F.size("v")).alias("v")))).alias("x"))
    half = half.select(F.concat_ws("_", "book", "x.h").alias("sample"), "author", F.explode("x.v").alias("lemma"))
    power = Y.separation(Y.delta_pairs(Y.z_table(half.select("sample", "lemma"), k=settings.n_mfw)), half.select("sample", "author").distinct()).first()
    return {"sections": Y.section_gaps(pairs, roles), "tests": tests, "same_author": power["same_author"], "diff_author": power["diff_author"], "separates": (power["ratio"] or 0) > settings.separation_ratio}
