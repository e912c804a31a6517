"""The corpus pipeline where copies, ids and targets are odd."""

import random

import corpus_pipeline as P
import numpy as np
from variorum.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_planted_copies_leave_one_document(spark, tmp_path):
    rng = random.Random(3)
    lines = lambda i: [f"{i} " + " ".join(f"w{rng.randrange(900)}" for _ in range(12)) for _ in range(rng.randint(5, 9))]
    texts = {i: "\n".join(lines(i)) for i in range(20)}
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()]
    rows += [(100 + i, texts[i], "en", "r", 0) for i in range(20)]
    rows += [(200 + i, texts[i] + " end", "en", "r", 0) for i in range(20)]
    rows += [(300, texts[0] + "\n" + texts[1], "en", "r", 0), (None, texts[2], "en", "r", 0)]
    docs = stored(spark, tmp_path, rows)
    left = P.dedup_lines(spark, docs, str(tmp_path))
    left = P.dedup_near(spark, left, str(tmp_path))
    before = [r["doc_id"] for r in left.collect()]
    got = P.one_of_each(spark, left, str(tmp_path))
    ids = [r["doc_id"] for r in got.collect()]
    assert got.columns == docs.columns and len(before) > len(ids)
    assert sorted(i for i in ids if i != 300) == list(range(20))
    drawn = {r["doc_id"] for r in P.mix_sources(spark, left, str(tmp_path)).collect()}
    assert drawn and drawn <= set(ids)


def test_capped_raking_meets_its_targets():
    rng = np.random.default_rng(2)
    keys = [(a, b, c) for a in "abcdef" for b in "xyz" for c in "pq"]
    tokens = np.round(10 ** rng.uniform(2, 5, len(keys))).astype(np.int64)
    exponents = [0.5, 0.7, 0.8]
    drawn = mixing.rake_capped(keys, tokens, exponents, 0.7)
    assert (drawn <= tokens * (1 + 1e-12)).all() and abs(drawn.sum() / tokens.sum() - 0.7) < 1e-3
    before = np.minimum(mixing.rake(keys, tokens, exponents, 10) * 0.7, tokens)
    worst = {"before": 0.0, "after": 0.0}
    for d, e in enumerate(exponents):
        names, code = np.unique([k[d] for k in keys], return_inverse=True)
        own = np.bincount(code, tokens)
        want = mixing.reachable((own / own.sum()) ** e / ((own / own.sum()) ** e).sum() * own.sum() * 0.7, own)
        for name, x in (("before", before), ("after", drawn)):
            worst[name] = max(worst[name], np.abs(np.bincount(code, x) / want - 1).max())
    assert worst["after"] < 0.01 < 0.05 < worst["before"]


def test_what_a_scarce_value_lacks_goes_to_the_others():
    got = mixing.reachable(np.array([50.0, 30.0, 20.0]), np.array([10.0, 200.0, 30.0]))
    assert got.tolist() == [10.0, 60.0, 30.0]


def test_capped_mixing_both_ways(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(1, 40) + rng.choice(["", "!!", "@ here"]), rng.choice(["en", "en", "en", "de"]), rng.choice("aaaaaab"), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    few = {r["doc_id"]: (r["_v_probability"], r["_v_weight"]) for r in mixing.calibrated(docs, capped=True).collect()}
    many = {r["doc_id"]: (r["_v_probability"], r["_v_weight"]) for r in mixing.calibrated(docs, capped=True, few_cells=2).collect()}
    assert few.keys() == many.keys() and all(abs(few[i][0] - many[i][0]) < 1e-4 for i in few)
    assert all(w == 1.0 for _, w in few.values()) and max(mixing.calibrated(docs).toPandas()["_v_weight"]) > 1
    assert mixing.calibrated(docs.filter("false"), capped=True).count() == 0 and mixing.calibrated(docs.filter("false"), capped=True, few_cells=-1).count() == 0


def test_near_dedup_decides_by_row(spark, tmp_path):
    rng = random.Random(8)
    a, b, c, d = ([f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(4))
    near = " ".join(a[:-1] + ["other"])
    rows = [(1, " ".join(a), "en", "s", 0), (1, " ".join(b), "en", "s", 0), (1, near, "en", "s", 0), (1, " ".join(a), "en", "s", 0), (2, near, "en", "s", 0)]
    rows += [(None, " ".join(c), "en", "s", 0), (None, " ".join(c), "en", "r", 0), (None, " ".join(d), "en", "s", 0), (None, " ".join(b), "en", "s", 0)]
    rows += [(3, None, "en", "s", 0), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (None, None, "en", "s", 0), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in P.dedup_near(spark, docs, str(tmp_path)).collect()]
    texts = {near, " ".join(a)}
    assert [i for i, t in got if t in texts] == [1]
    rest = sorted(((i, t) for i, t in got if t not in texts), key=str)
    assert rest == sorted([(1, " ".join(b)), (None, " ".join(c)), (None, " ".join(d)), (3, None), (4, ""), (None, None)], key=str)
