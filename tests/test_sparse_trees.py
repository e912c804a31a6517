"""Trees from links against trees from full matrices; pairs that are never made against all pairs."""

import numpy as np
import pytest

from variorum.operators import coherence as C
from variorum.operators import statistics as S
from variorum.operators import trees
from variorum.plans import genealogy


def drawn(n, share, seed, steps=None):
    rng = np.random.default_rng(seed)
    i, j = np.triu_indices(n, 1)
    on = rng.random(len(i)) < share
    d = rng.integers(1, steps, int(on.sum())) / steps if steps else rng.random(on.sum()) * 0.9
    return trees.Links([f"w{k:04d}" for k in range(n)], i[on], j[on], d)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.2, 1.0])
@pytest.mark.parametrize("steps", [None, 4])
def test_linkage_from_links(monkeypatch, share, steps):
    monkeypatch.setattr(trees, "SMALL", 0)
    links = drawn(60, share, 7, steps)
    full = trees.average_linkage(links.names, links.full())
    for few in (links, trees.Links(links.names, links.i, links.j, links.distance)):
        got = trees.average_linkage_of(few)
        assert all(np.array_equal(getattr(got, k), getattr(full, k)) for k in ("left", "right", "height", "size"))
    for k in (1, 3, 12, 60):
        assert np.array_equal(got.cut(k), full.cut(k))
    clades = full.clades()
    asked = {1, 5, 17}
    assert trees.smallest_clade(full, ["w0001", "w0005", "w0017"])[1] == min((c for c in clades if asked <= c), key=len)


@pytest.mark.parametrize("share", [0.0, 0.05, 0.3, 1.0])
def test_joining_from_links(spark, share):
    links = drawn(18, share, 3, 8)  # eighths: sums and halves are exact, so ties are ties in both
    plain = {",".join(sorted(x)) for x in trees.splits(trees.neighbor_joining(links.names, links.full()))}
    got = [r["members"] for r in trees.split_rows(spark, links.names, trees.joined(links)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain


def test_trees_of_more_witnesses_than_a_matrix_takes(spark):
    n = trees.MOST_WITNESSES + 1_000
    links = trees.Links([f"w{k:05d}" for k in range(n)], np.array([3, 3]), np.array([4, 9]), np.array([0.2, 0.3]))
    tree = trees.average_linkage_of(links)
    assert tree.height[0] == 0.2 and tree.size[-1] == n and set(tree.cut(12)) == {1} and trees.recovered(tree, ["w00003", "w00004"])
    joins = trees.joined(links)
    assert len(joins) == n - 2 and joins[0] == (4, 3)


def matrix(spark, seed=1, units=40, n=12):
    rng = np.random.default_rng(seed)
    rows = [(f"u{u:02d}", f"w{w}", "abc"[rng.integers(0, 3)]) for u in range(units) for w in range(n) if rng.random() < (0.2 if w == 3 else 0.8)]
    return spark.createDataFrame(rows, "app_id string, base_ga string, reading_id string")


def test_what_is_asked_of_all_pairs_without_making_them(spark):
    m = matrix(spark)
    own = {}
    for r in m.collect():
        own.setdefault(r["base_ga"], {})[r["app_id"]] = r["reading_id"]
    names, least = sorted(own), 26
    d = {}
    for a in names:
        for b in names:
            both = own[a].keys() & own[b].keys()
            d[a, b] = 1.0 if len(both) < least else 1 - sum(own[a][u] == own[b][u] for u in both) / len(both)
    full = {(r["w1"], r["w2"]): r["distance"] for r in C.distances(m, least).collect()}
    assert full == pytest.approx({k: v for k, v in d.items() if k[0] < k[1]})
    near = C.near(m, least)
    assert 0 < near.pairs.count() < len(full)
    got = {(r["w1"], r["nth"]): (r["w2"], r["distance"]) for r in C.nearest(near, 3).collect()}
    for a in names:
        for k, (x, b) in enumerate(sorted((d[a, b], b) for b in names if b != a)[:3]):
            assert got[a, k + 1][0] == b and got[a, k + 1][1] == pytest.approx(x)
    family = {w: "xy"[k % 2] if k else "alone" for k, w in enumerate(names)}
    f = spark.createDataFrame([*family.items(), ("stranger", "x"), ("w5", None)], "base_ga string, family string")
    mean = lambda xs: sum(xs) / len(xs)
    homogeneous = {k: 1 - mean([d[a, b] for a in names for b in names if a < b and family[a] == family[b] == k]) for k in "xy"}
    assert {r["family"]: r["homogeneity"] for r in C.homogeneity(near, f).collect()} == pytest.approx(homogeneous)
    points = {}
    for a in names:
        by = {k: mean([d[a, b] for b in names if b != a and family[b] == k]) for k in {family[b] for b in names if b != a}}
        if family[a] in by:
            own_, other = by[family[a]], min(v for k, v in by.items() if k != family[a])
            points[a] = (other - own_) / max(own_, other)
    assert {r["base_ga"]: r["silhouette"] for r in C.silhouette_points(near, f).collect()} == pytest.approx(points)


def test_support_from_links(spark, monkeypatch):
    m = matrix(spark, 4)
    families = {"a": ["w0", "w1"], "b": ["w2", "w4", "w5", "none"], "c": ["w7"]}
    monkeypatch.setattr(genealogy, "AT_ONCE", 50)
    got = {r["family"]: r["support"] for r in genealogy.bootstrap_support(m, families, 20, 5, 24).collect()}
    names, units = (sorted({r[k] for r in m.collect()}) for k in ("base_ga", "app_id"))
    own = {(r["app_id"], r["base_ga"]): ord(r["reading_id"]) for r in m.collect()}
    codes = np.array([[own.get((u, w), -1) for w in names] for u in units])
    hits = dict.fromkeys(families, 0)
    for rep in range(20):
        drawn = codes[np.random.default_rng([5, rep]).integers(0, len(units), len(units))]
        both = (drawn[:, :, None] >= 0) & (drawn[:, None, :] >= 0)
        overlap, agree = both.sum(0), (both & (drawn[:, :, None] == drawn[:, None, :])).sum(0)
        d = np.where(overlap < 24, 1.0, 1.0 - agree / np.maximum(overlap, 1))
        np.fill_diagonal(d, 0.0)
        tree = trees.average_linkage(names, d)
        for f, ms in families.items():
            hits[f] += trees.recovered(tree, ms)
    assert got == pytest.approx({f: round(h / 20, 3) for f, h in hits.items()}) and 0 < sum(hits.values())


def test_numbers_are_places_in_order(spark):
    values = [f"v{k * 7919 % 100_003}" for k in range(20_000)]
    got = [(r["x"], r["at"]) for r in S.numbered(spark.createDataFrame([(v,) for v in values + values[:50] + [None]], "x string").repartition(5), "x").collect()]
    assert sorted(got) == [(v, k) for k, v in enumerate(sorted(values))]
