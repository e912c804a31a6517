"""Steps that grew faster than their input: what they give, and that their plans do without the fault."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from variorum.operators import choose
from variorum.operators import stylometry as Y
from variorum.plans import export, reading_queries
from variorum.plans import metrics as M

from test_collation import build


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def c(spark):
    return build(spark)


def test_containers_without_pairs(spark):
    draw = random.Random(5)
    number = lambda: draw.choice([None, *range(8)])
    rows = [(f"v{k % 3}" if k % 17 else None, f"u{k}", number(), number()) for k in range(150)] + [("w", "x1", 1, 5), ("w", "x2", 1, 5), ("w", "x3", 9, 2)]
    units = spark.createDataFrame(rows, "verse_id string, app_id string, app_from int, app_to int")
    inside = lambda o, i: o[0] == i[0] and i[2] >= o[2] and i[3] <= o[3] and o[2:] != i[2:]
    known = [r for r in rows if None not in r]
    found = M.containers(units)
    assert sorted(map(tuple, found.collect())) == sorted(o[:2] for o in known if any(inside(o, i) for i in known))
    assert "left_semi" not in plan(found).lower().replace("leftsemi", "left_semi")


def test_attestation_is_shuffled_once(spark, c):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = choose.one_reading(c, "raw")
        before = plan(c.attestation.repartition("app_id")).count("Exchange")
        # attestation, readings and units (twice) by unit, and nothing after they met
        assert plan(rows).count("Exchange hashpartitioning") <= before + 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_settled_choices_are_the_same(c):
    known = choose.settled(c)
    for policy in ("fold", "raw"):
        for base in (False, True):
            a, b = (sorted(map(str, choose.one_reading(x, policy, base).select("app_id", "base_ga", "reading_id", "reading_type", "is_lemma").collect())) for x in (c, known))
            assert a == b
    assert sorted(map(tuple, choose.extant(known).distinct().collect())) == sorted(map(tuple, choose.extant(c).distinct().collect()))


def test_support_of_readings_without_expansion(spark, c):
    double = c.with_witnesses(c.witnesses.union(spark.createDataFrame([("W1", "F9", 300), ("W6", None, 5)], "base_ga string, family string, date_mid int")))
    found = M.family_support(double)
    got = {(r["app_id"], r["reading_id"]): (r["n_wit"], r["n_families"], r["families"]) for r in found.collect()}
    assert got[("U1", "a")] == (2, 2, "F1,F9") and got[("U1", "d")] == (2, 2, "F2,F3") and got[("U1", "c")] == (2, 2, "F2,F3") and got[("U2", "a")] == (1, 0, "")
    assert "Expand" not in plan(found)


def test_omitters_narrow_the_attestation_first(c):
    text = plan(M.includers_omitters(c, "B04K1V2", ["B04K1V1"]))
    assert "BroadcastHashJoin" in text


def test_sequences_without_one_task(spark):
    matrix = spark.createDataFrame([("u1", "w1", "a"), ("u1", "w2", "b"), ("u2", "w2", "a"), ("u3", "w3", "a")], "app_id string, base_ga string, reading_id string")
    rows = export.character_rows(matrix, "01")
    assert {r["base_ga"]: r["sequence"] for r in rows.collect()} == {"w1": "0??", "w2": "10?", "w3": "??0"}
    assert {r["sequence"] for r in export.character_rows(matrix, "").collect()} == {""}
    assert not re.search(r"windowspecdefinition\((app_id#\d+ ASC|specifiedwindowframe)", plan(rows))


def test_windows_in_pieces(spark):
    rows = [("b", k, " ".join(random.Random(k).choices("abcdefg", k=k % 13))) for k in range(40)]
    pieces = Y.window_pieces(spark.createDataFrame(rows, "book string, doc_id int, text string"), ("book",), 5)
    line = [w for _, _, t in rows for w in t.split()]
    found = {r["window"]: (r["n"], r["n_types"], r["first_type"], r["opens"]) for r in Y.window_figures(pieces, ("book",)).collect()}
    parts = {k // 5: line[k : k + 5] for k in range(0, len(line), 5)}
    assert found == {k: (len(p), len(set(p)), min(p), p[0]) for k, p in parts.items() if len(p) >= 3.75}


def test_inflation_by_a_constant_is_undefined(spark, c, monkeypatch):
    rows = spark.createDataFrame([(x, 0.0, y) for x, y in ((-1.0, 0.2), (0.0, 0.5), (1.0, 0.1), (0.5, 0.9))], "coverage_z double, verse_length_z double, between_family_split double")
    monkeypatch.setattr(M, "standardised_covariates", lambda _: rows)
    assert math.isnan(reading_queries._one_term(c).first()["vif"])
    varied = rows.withColumn("verse_length_z", F.col("between_family_split"))
    monkeypatch.setattr(M, "standardised_covariates", lambda _: varied)
    assert reading_queries._one_term(c).first()["vif"] >= 1.0
