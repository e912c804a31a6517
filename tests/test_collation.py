"""A hand-computed collation: both policies, ties, lacunae, missing families."""

import random

import pytest

from variorum.operators import coherence as C
from variorum.operators.choose import one_reading
from variorum.plans import metrics as M
from variorum.schema import Collation

UNITS = [("U1", 1, 1, 0, 2, "main"), ("U2", 1, 1, 4, 4, "main"), ("U3", 1, 2, 0, 0, "main"), ("U4", 1, 2, 0, 0, "lac")]
KINDS = {"a": None, "b": None, "c": "om", "d": "subreading", "z": "lac"}
SEEN = """U1 W1 a first;U1 W1 b corr;U1 W2 b first;U1 W3 d first;U1 W4 c first;U1 W5 z first;U1 W6 c corr;U1 W6 d corr;U1 basetext a first;
U2 basetext a first;U2 W1 z first;U3 W1 a first;U3 W2 a first;U3 basetext a first;U4 W1 a first"""


def build(spark, shuffle=False):
    seen = [x.split() for x in SEEN.replace("\n", "").split(";")]
    if shuffle:
        random.Random(3).shuffle(seen)
    units = spark.createDataFrame([(u, "B04", c, v, f"B04K{c}V{v}", a, b, k, "word") for u, c, v, a, b, k in UNITS], "app_id string, book string, chapter int, verse int, verse_id string, app_from int, app_to int, app_type string, lemma_text string")
    readings = spark.createDataFrame([(u[0], r, k, r, r == "a") for u in UNITS for r, k in KINDS.items()], "app_id string, reading_id string, reading_type string, reading_text string, is_lemma boolean")
    att = spark.createDataFrame([(u, r, w, "firsthand" if h == "first" else "corrector") for u, w, r, h in seen], "app_id string, reading_id string, base_ga string, hand string")
    wit = spark.createDataFrame([("W1", "F1", 300), ("W2", "F1", 900), ("W5", "F1", 900), ("W3", "F2", 400), ("W4", "F2", None), ("W6", "F3", 1200)], "base_ga string, family string, date_mid int")
    return Collation(units, readings, att, wit)


@pytest.fixture(scope="module")
def c(spark):
    return build(spark)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_policies(c):
    fold = {(r["app_id"], r["base_ga"]): r["reading_id"] for r in one_reading(c, "fold").collect()}
    raw = {(r["app_id"], r["base_ga"]): r["reading_id"] for r in one_reading(c, "raw").collect()}
    base = {("U1", "W1"): "a", ("U1", "W2"): "b", ("U1", "W3"): "d", ("U1", "W4"): "c", ("U3", "W1"): "a", ("U3", "W2"): "a"}
    assert fold == base | {("U1", "W6"): "d"}
    assert raw == base | {("U1", "W6"): "c"}


def test_instability(c):
    got = rows(M.unit_instability(c), "app_id")
    assert [got[(u,)]["n_extant"] for u in ("U1", "U2", "U3")] == [5, 0, 2]
    assert [got[(u,)]["n_lemma"] for u in ("U1", "U2", "U3")] == [3, 0, 2]
    assert [got[(u,)]["instability"] for u in ("U1", "U2", "U3")] == [0.4, None, 0.0]
    assert got[("U1",)]["n_subst_readings"] == 3 and ("U4",) not in got


def test_consensus(c):
    got = rows(M.unit_stability(c), "app_id")
    assert set(got) == {("U1",), ("U3",)}
    assert got[("U1",)]["consensus"] == 0.6 and not got[("U1",)]["tied"]
    assert got[("U1",)]["family_consensus"] == pytest.approx(2 / 3) and got[("U1",)]["n_fam"] == 3
    assert got[("U3",)]["family_consensus"] is None and got[("U3",)]["n_fam"] == 1
    assert (got[("U3",)]["is_anchor"], got[("U3",)]["is_family_anchor"]) == (True, False)


def test_family_vote(c):
    got = rows(M.family_vote(c), "app_id")
    assert got[("U1",)]["family_instability"] == pytest.approx(2 / 3) and got[("U1",)]["between_family_split"]
    assert got[("U3",)]["family_instability"] == 0.0 and not got[("U3",)]["between_family_split"]


def test_confidence_and_index(c):
    got = rows(M.confidence(c), "verse_id")[("B04K1V1",)]
    assert got["n_families"] == 3 and got["eff_families"] == pytest.approx(25 / 9) and got["n_early"] == 2
    index = rows(M.verse_index(c), "verse_id")
    assert index[("B04K1V1",)]["low_conf"] and index[("B04K1V2",)]["stability"] == 1.0


def test_drilldown(c):
    got = rows(M.unit_drilldown(c), "app_id")
    assert got[("U1",)]["has_variation"] and got[("U1",)]["weight"] == "branch" and not got[("U1",)]["orthographic"]
    assert got[("U2",)]["n_variant_wit"] == 0 and not got[("U2",)]["has_variation"]
    verse = rows(M.verse_drilldown(c), "verse_id")[("B04K1V1",)]
    assert verse["text"] == "word word" and verse["n_variation_units"] == 1


def test_homogeneous_thresholds(spark):
    def matrix(n, differ):
        return spark.createDataFrame([(f"u{i}", w, "a" if w == "x" or i >= differ else "b") for i in range(n) for w in ("x", "y")], "app_id string, base_ga string, reading_id string")

    assert C.distances(matrix(99, 10), 100).first()["distance"] == 1.0
    assert C.distances(matrix(100, 10), 100).first()["distance"] == pytest.approx(0.1)
    modal = spark.createDataFrame([("u", f"w{i}", "a" if i < 27 else "b") for i in range(30)], "app_id string, base_ga string, reading_id string")
    assert C.informative_units(modal, 30, 0.90).count() == 0 and C.informative_units(modal, 30, 0.91).count() == 1
    assert C.informative_units(modal, 31, 0.91).count() == 0


def test_order_of_rows_is_irrelevant(spark, c):
    a = sorted(map(str, M.unit_stability(c).collect()))
    b = sorted(map(str, M.unit_stability(build(spark, shuffle=True)).collect()))
    assert a == b


def test_omitters(c):
    got = {(r["base_ga"], r["role"]) for r in M.includers_omitters(c, "B04K1V2", ["B04K1V1"]).collect()}
    assert got == {("W1", "includer"), ("W2", "includer"), ("W3", "omitter"), ("W4", "omitter"), ("W6", "omitter")}


def test_families(spark):
    w = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "base_ga string")
    big = spark.createDataFrame([("1",), ("3",)], "base_ga string")
    got = {r["base_ga"]: (r["family"], r["weight"]) for r in M.witness_weights(M.assign_families(w, {"f1": ("list", ["1", "2"])}, big)).collect()}
    assert got == {"1": ("f1", 0.5), "2": ("f1", 0.5), "3": ("Byz", 1.0), "4": ("other", 1.0)}


def test_windows_count_every_row(spark):
    from variorum.operators import stylometry as Y

    rows = [("b", 1, "x y z"), ("b", 1, "x y z"), ("b", 1, "u v"), ("b", None, "first one"), ("b", 2, None), (None, 1, "p q"), ("c", 5, "")]
    got = Y.token_windows(spark.createDataFrame(rows, "book string, doc_id int, text string").repartition(3), ("book",), 5)
    words = {}
    for r in got.collect():
        words.setdefault(r["book"], {})[r["window"] * 5 + r["pos"]] = r["lemma"]
    line = " ".join(words["b"][i] for i in range(10))
    assert line.startswith("first one ") and line.count("x y z") == 2 and line.count("u v") == 1 and None not in words
