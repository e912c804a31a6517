import pytest
from pyspark.sql import functions as F

from variorum.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("B04K1V1", ("B04", 1, 1)), ("B04K21V25", ("B04", 21, 25)), ("garbage", ("", -1, -1)), (None, ("", -1, -1))])
def test_verse_id(spark, given, want):
    assert tuple(one(spark, X.parse_verse_id(F.lit(given).cast("string")))) == want


@pytest.mark.parametrize(
    "siglum, base, hand",
    [
        ("01", "01", "firsthand"), ("01*", "01", "firsthand"), ("01Cca", "01", "corrector"), ("01S1", "01", "corrector"), ("P66", "P66", "firsthand"), ("884", "884", "firsthand"),
        ("050-1", "050", "instance"), ("L252-S1W1D1a", "L252", "lection"), ("basetext", "basetext", "firsthand"), ("01V", "01", "firsthand"), ("L5C", "L5", "corrector"), ("01x", "01", "other"),
    ],
)
def test_siglum(spark, siglum, base, hand):
    s = F.lit(siglum)
    assert (one(spark, X.siglum_base(s)), one(spark, X.siglum_hand(s))) == (base, hand)


@pytest.mark.parametrize(
    "siglum, want", [("P66", 10066), ("P75", 10075), ("01", 20001), ("03", 20003), ("019", 20019), ("1", 30001), ("13", 30013), ("1582", 31582), ("L1000", 41000), ("basetext", None), ("", None)]
)
def test_docid(spark, siglum, want):
    assert one(spark, X.ga_to_docid(F.lit(siglum))) == want


@pytest.mark.parametrize(
    "orig, want", [("XII", (1100, 1199)), ("VI/VII", (500, 699)), ("III (A)", (200, 299)), ("948", (948, 948)), ("948.0", (948, 948)), ("X/XI", (900, 1099)), ("", (None, None)), ("IIII", (None, None)), ("xv", (1400, 1499)), (None, (None, None))]
)
def test_dates(spark, orig, want):
    assert tuple(one(spark, X.parse_orig(F.lit(orig).cast("string")))) == want


@pytest.mark.parametrize("place, want", [((1, 1), "prologue"), ((1, 19), "body"), ((15, 1), "farewell"), ((21, 1), "appendix"), ((3, 16), "body")])
def test_section(spark, place, want):
    assert one(spark, X.section(F.lit(place[0]), F.lit(place[1]))) == want


@pytest.mark.parametrize("place, want", [((6, 10), True), ((19, 18), True), ((3, 16), False)])
def test_synoptic(spark, place, want):
    assert one(spark, X.is_synoptic(F.lit(place[0]), F.lit(place[1]))) is want


def test_words_and_links(spark):
    assert one(spark, X.words(F.lit("  a\tb  c "))) == ["a", "b", "c"]
    assert one(spark, X.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, X.link(F.lit("http://x/{ga}"), F.lit("01"), F.lit(True))) == "http://x/01"
    assert tuple(one(spark, X.word_place(F.lit(5)))) == ("gap", 2)


@pytest.mark.parametrize("numeral, want", [("MCMXCIX", 1999), ("xlix", 49), ("XLI", 41), ("MMMM", 4000), ("IIX", None), ("IC", None), ("VV", None), ("", None), (" ix ", 9), ("A", None)])
def test_any_canonical_numeral(spark, numeral, want):
    assert one(spark, X.century(F.lit(numeral))) == want


def test_every_numeral(spark):
    signs = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    rows = []
    for n in range(1, 1200):
        left, text = n, ""
        for value, sign in signs:
            text += sign * (left // value)
            left %= value
        rows.append((n, text))
    assert spark.createDataFrame(rows, "n int, s string").filter(~X.century("s").eqNullSafe(F.col("n"))).count() == 0


def test_long_numbers_are_read_whole(spark):
    assert one(spark, X.ga_to_docid(F.lit("P" + "0" * 30 + "66"))) == 10066 and one(spark, X.ga_to_docid(F.lit("P1" + "0" * 30))) is None and one(spark, X.ga_to_docid(F.lit("P" + "1" * 20 + "x"))) is None
