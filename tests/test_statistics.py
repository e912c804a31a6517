import math

import numpy as np
import pytest

from variorum.operators import regression as R
from variorum.operators import statistics as S
from variorum.operators import trees as T


def test_tails():
    assert R.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert R.chi2_sf(7.814727903, 3) == pytest.approx(0.05, abs=1e-8)
    assert R.chi2_sf(2 * math.log(10), 2) == pytest.approx(0.1, abs=1e-12)


def test_ols_is_exact_and_hc3_matches_its_formula(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=60) * (1 + abs(x[:, 0]))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    fit = R.ols_hc3(df, "y", ["a", "b"])
    design = np.column_stack([np.ones(60), x])
    inverse = np.linalg.inv(design.T @ design)
    coef = inverse @ design.T @ y
    e = y - design @ coef
    h = np.einsum("ij,jk,ik->i", design, inverse, design)
    cov = inverse @ (design.T * (e / (1 - h)) ** 2) @ design @ inverse
    assert np.allclose(fit.coef, coef) and np.allclose(fit.cov, cov)
    stat, p = fit.wald(["a", "b"])
    assert stat > 10 and p < 0.01
    corr = np.corrcoef(x.T)[0, 1]
    assert R.vif(df, ["a", "b"])["a"] == pytest.approx(1 / (1 - corr**2))


def test_fractional_logit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = 1 / (1 + np.exp(-(0.5 + 0.8 * x)))
    df = spark.createDataFrame([(float(a), float(b), 3.0) for a, b in zip(x, y)], "x double, y double, w double")
    assert np.allclose(R.fractional_logit(df, "y", ["x"], "w").coef, [0.5, 0.8], atol=1e-6)


def test_block_permutation_enumerates_all_windows(spark):
    values = [9, 8, 1, 2, 9, 7, 8, 9, 6, 7]
    df = spark.createDataFrame([(1, i, f"v{i}", float(x)) for i, x in enumerate(values)], "chapter int, verse int, verse_id string, x double")
    got = S.block_permutation(df, "x", ["v2", "v3"]).first()
    assert got["n_windows"] == 9 and got["n_as_low"] == 1 and got["p_value"] == pytest.approx(1 / 9)
    assert S.iid_permutation(df, "x", ["v2", "v3"], 200, 1).first()["p_value"] < 0.1


def test_bh_and_ranks(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double")
    got = {r["k"]: r["p_fdr"] for r in S.benjamini_hochberg(df).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 0.5})
    ties = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert sorted(r["r"] for r in ties.select(S.average_rank("x").alias("r")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_mann_whitney_and_medians(spark):
    rows = [(i, "a", float(i)) for i in range(8)] + [(10 + i, "b", float(i + 6)) for i in range(8)]
    df = spark.createDataFrame(rows, "k int, g string, x double")
    got = S.mann_whitney(df, "x", "g", "a", "b").first()
    u = sum((p[2] > q[2]) + 0.5 * (p[2] == q[2]) for p in rows[:8] for q in rows[8:])
    assert got["u"] == u and got["p_less"] < 0.01
    m = S.median_permutation(df, "x", "g", "a", "b", 200, 1, "k").first()
    assert m["difference"] == -6.0 and m["p_value"] < 0.05


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"u{i}", i % 3, float(i % 7)) for i in range(90)], "k string, g int, x double")
    a = sorted(map(tuple, S.bootstrap_intervals(df, "k", "g", ["x"], 50, 7).collect()))
    b = sorted(map(tuple, S.bootstrap_intervals(df.repartition(7), "k", "g", ["x"], 50, 7).collect()))
    assert np.allclose(a, b)


def test_linkage_against_brute_force():
    rng = np.random.default_rng(0)
    x = rng.random((12, 12))
    d = (x + x.T) / 2
    np.fill_diagonal(d, 0)
    tree = T.average_linkage([f"w{i:02d}" for i in range(12)], d)
    groups, heights = [[i] for i in range(12)], []
    while len(groups) > 1:
        h, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(h)
        groups[i] += groups.pop(j)
    assert np.allclose(tree.height, heights)
    assert len(set(tree.cut(4))) == 4 and tree.size[-1] == 12


def test_ties_merge_together():
    d = np.ones((5, 5))
    np.fill_diagonal(d, 0)
    d[0, 1] = d[1, 0] = 0.1
    assert len(set(T.average_linkage(list("abcde"), d).cut(3))) == 1


def test_neighbor_joining_recovers_an_additive_tree():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    tree = T.neighbor_joining(list("abcde"), d)
    assert T.splits(tree) == {frozenset("cde"), frozenset("de")}
    assert T.newick(T.ladderize(tree)).endswith(";")


def test_whole_column_ranks_need_no_single_task(spark):
    rng = np.random.default_rng(5)
    x = [float(v) for v in rng.integers(0, 400, 3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "k int, x double").repartition(7)
    order = np.sort(x)
    want = {v: (np.searchsorted(order, v) + 1 + np.searchsorted(order, v, side="right")) / 2 for v in set(x)}
    assert all(r["rank"] == want[r["x"]] for r in S.ranked(df, "x").collect())
    p = np.array(x) / 400
    got = {r["k"]: r["p_fdr"] for r in S.benjamini_hochberg(df.select("k", (df.x / 400).alias("p"))).collect()}
    q = p[np.argsort(p, kind="stable")] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(1.0, np.minimum.accumulate(q[::-1])[::-1])
    assert np.allclose([got[int(i)] for i in np.argsort(p, kind="stable")], q)
    assert S.benjamini_hochberg(df.select("k", df.x.alias("p")).filter("false")).count() == 0


def test_lower_percentiles(spark):
    rows = [("a", v) for v in (5.0, 1.0, 1.0, 2.0, None)] + [("b", 7.0), ("c", None)]
    got = {r["g"]: r["q"] for r in S.lower_percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 0.7, "q").collect()}
    assert got == {"a": 2.0, "b": 7.0}
