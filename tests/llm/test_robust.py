"""Robust estimates and verdicts against a plain search over many random starts."""

import random

import numpy as np
from pyspark.sql import functions as F
from variorum.llm import quality

FLOOR = (quality.UNIT / 8) ** 2


def plain_mcd(x, share=0.75, starts=400, seed=0):
    """The least log determinant over random subsets with concentration steps, and its centre and covariance."""
    rng, h, best = np.random.default_rng(seed), int(np.ceil(share * len(x))), None
    for _ in range(starts):
        take = rng.choice(len(x), 6, replace=False)
        for _ in range(30):
            c, v = x[take].mean(0), np.cov(x[take].T, bias=True) + FLOOR * np.eye(4)
            d = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(v), x - c)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(take):
                break
            take = new
        det = np.linalg.slogdet(v)[1]
        if best is None or det < best[0]:
            best = det, c, v
    return best


def frame(spark, x, group="g"):
    return spark.createDataFrame([(group, *map(int, r)) for r in x], "k string, _v_x0 long, _v_x1 long, _v_x2 long, _v_x3 long").repartition(3)


def contaminated(seed, n=160, bad=40):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(4, 4)) * 60
    x = rng.normal(size=(n, 4)) @ a + [500, 900, 700, 300]
    x[:bad] = rng.normal(size=(bad, 4)) * 20 + rng.choice([-1, 1], 4) * 900 + [500, 900, 700, 300]
    return np.round(x)


def test_determinants_are_the_least_of_many_starts(spark):
    sets = {f"g{s}": contaminated(s) for s in range(4)}
    df = None
    for name, x in sets.items():
        df = frame(spark, x, name) if df is None else df.union(frame(spark, x, name))
    got = {r["k"]: r for r in quality.estimates(df, ["k"]).collect()}
    for name, x in sets.items():
        det, c, v = plain_mcd(x)
        assert got[name]["n"] == len(x) and got[name]["det"] < det + 0.1
        low = np.array([[got[name][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        d = lambda m, w: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(w), x - m)
        mine, plain = d(np.array([got[name][f"c{i}"] for i in range(4)]), low @ low.T), d(c, v)
        assert mine[:40].min() > 5 * np.quantile(mine[40:], 0.9) and np.corrcoef(np.log(mine), np.log(plain))[0, 1] > 0.98


def test_a_start_that_is_not_the_medians_can_win(spark):
    # two clusters: most coordinates' quartile ranges span both, the tight larger one has the least determinant
    rng = np.random.default_rng(9)
    x = np.round(np.vstack([rng.normal(0, 30, (160, 4)), rng.normal(1500, 300, (50, 4))]))
    row = quality.estimates(frame(spark, x), ["k"]).first()
    assert row["det"] < plain_mcd(x)[0] + 0.1 and max(abs(row[f"c{i}"]) for i in range(4)) < 30


def test_verdicts_of_texts(spark):
    rng = random.Random(3)
    words = [f"{''.join(rng.choice('abcdefghijklmnop') for _ in range(rng.randint(2, 9)))}" for _ in range(600)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choices(words, k=rng.randint(40, 120)))
        if i % 12 == 0:
            text = " ".join(w.upper() + rng.choice("#%&$") * 3 for w in text.split())
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", f"small{i % 30}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert all(got[i]["kept"] == (i % 12 != 0) for i in got) and all(r["distance"] is not None for r in got.values())
    # by the definition: distances under a plain estimate of the same groups give the same verdicts
    told = quality.counted(docs).select("doc_id", "lang", "source", *quality.STATS).toPandas()
    x = told[list(quality.STATS)].to_numpy(float)
    sizes = told.groupby(["lang", "source"])["doc_id"].transform("size").to_numpy()
    pooled = told[sizes < 50].groupby("lang").size()
    names = [f"{r.lang}/{r.source}" if n >= 50 else (r.lang if pooled[r.lang] >= 50 else "all") for r, n in zip(told.itertuples(), sizes)]
    cut = quality.chi2_quantile(1 - 1e-9, 4)
    scale = quality.chi2_cdf(quality.chi2_quantile(0.75, 4), 6) / 0.75
    for name in set(names):
        at = np.array([n == name for n in names])
        _, c, v = plain_mcd(x[at], starts=60)
        d = np.einsum("ij,jk,ik->i", x[at] - c, np.linalg.inv(v), x[at] - c) * scale
        clear = np.abs(np.log(d / cut)) > 0.3
        assert [got[i]["kept"] for i, k in zip(told["doc_id"][at], clear) if k] == [bool(y <= cut) for y, k in zip(d, clear) if k] and clear.mean() > 0.9


def test_many_groups_take_the_other_join(spark, monkeypatch):
    from variorum.llm import _frames

    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60)), "en", f"s{i % 2}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    key = lambda rs: sorted(tuple(r) for r in rs)
    few = key(quality.judged(docs).collect())
    monkeypatch.setattr(_frames.with_facts, "__defaults__", (0,))
    assert key(quality.judged(docs.withColumn("distance", F.lit(1))).collect()) == few
