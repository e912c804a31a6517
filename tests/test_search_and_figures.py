"""Addresses and filters, exact rounding, figures, exact tails of small samples, validation and style reports."""

import random
from itertools import combinations
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from variorum.functions import search
from variorum.functions import text as X
from variorum.operators import statistics as S
from variorum.operators import trees
from variorum.plans import figures


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("query, want", [("3:16", "verse/B04K3V16"), (" 3 . 16 ", "verse/B04K3V16"), ("3 16", "verse/B04K3V16"), ("21", "chapter/21"), ("22", None), ("0", None), ("3:", None), ("abc", None), ("123:4", None), (None, None)])
def test_jump(spark, query, want):
    assert one(spark, search.jump(F.lit(query).cast("string"))) == want


@pytest.mark.parametrize("address, want", [("#/", ("overview", None)), ("#/verse/B04K1V1", ("verse", "B04K1V1")), ("#/chapter/7", ("chapter", "7")), ("#/about", ("about", None)), ("#/x/y", ("overview", None)), (None, ("overview", None))])
def test_route(spark, address, want):
    assert tuple(one(spark, search.route(F.lit(address).cast("string")))) == want


def test_filter_and_ramp(spark):
    df = spark.createDataFrame([("P66", "Bodmer"), ("01", None), ("a.b", "x")], "ga string, name string")
    got = lambda q: [r["ga"] for r in df.filter(search.matches(F.lit(q), "ga", "name")).collect()]
    assert got("bod") == ["P66"] and got("") == ["P66", "01", "a.b"] and got("A.") == ["a.b"] and got("%") == []
    assert [one(spark, search.ramp(F.lit(v), F.lit(0.0), F.lit(2.0))) for v in (-1.0, 1.0, 5.0)] == [0.0, 0.5, 1.0] and one(spark, search.ramp(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0


@pytest.mark.parametrize("digits", [0, 2, 3, 4])
def test_rounding_is_by_the_binary_value(spark, digits):
    rng = random.Random(digits)
    values = [0.0, 0.5, 1.5, 2.5, 2.675, 1.005, 0.125, 0.00005, 0.00015, 1e-30, -2.675, -0.5, 1e300, 123456.78905, 2.0**43 + 0.5, 0.9999999999]
    values += [rng.random() for _ in range(300)] + [round(rng.random(), 5) for _ in range(300)] + [rng.uniform(-1e4, 1e4) for _ in range(200)] + [k / 32 for k in range(64)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", X.binary_round("v", digits).alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: round(v, digits) for i, v in enumerate(values)}
    assert one(spark, X.binary_round(F.lit(None).cast("double"), digits)) is None


def test_exact_tails():
    for n1, n2 in ((3, 4), (5, 3), (1, 6)):
        every = [sum(x > y for x in c for y in set(range(n1 + n2)) - set(c)) for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert S.exact_mann_whitney(u, n1, n2) == pytest.approx(sum(e <= u for e in every) / len(every))


def test_figures(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.2, None), (2, 0.4, 0.1), (3, 0.1, 0.3)], "chapter int, a double, b double")
    chart = ElementTree.parse(figures.line_chart(df, "chapter", {"a": "one <way>", "b": "other"}, tmp_path / "x" / "c.svg", "T & t"))
    assert len(chart.findall(".//{*}circle")) == 5 and len(chart.findall(".//{*}polyline")) == 2
    rng = np.random.default_rng(1)
    d = rng.random((7, 7))
    d = d + d.T
    np.fill_diagonal(d, 0)
    tree = trees.average_linkage(list("abcdefg"), d)
    drawn = ElementTree.parse(figures.dendrogram(tree, tmp_path / "t.svg", {"a": "f1"}))
    assert sorted(t.text for t in drawn.findall(".//{*}text")) == list("abcdefg") and len(drawn.findall(".//{*}path")) == 6
