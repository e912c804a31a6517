import pytest

#: Nulls in every column, empty and blank texts, a very long text, ties and repeated rows.
ODD = [
    (1, "The cat sat on the mat and the dog lay on the rug by the door.\nIt was a quiet day in the house.\nAll of them slept well.", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", None, "s2"),
    (4, " \n\t ", "en", None),
    (5, "1234 5678 ###", "de", "s2"),
    (6, "Der Hund und die Katze sind im Haus und schlafen auf dem Teppich.", "de", "s2"),
    (7, "Der Hund und die Katze sind im Haus und schlafen auf dem Teppich.", "de", "s1"),
    (8, "word " * 30_000, None, "s3"),
    (None, "An id is missing here, but the text is not.", "en", "s1"),
    (9, "naïve café — 漢字 🙂 token = \"abcDEF123\"", "fr", "s1"),
    (9, "naïve café — 漢字 🙂 token = \"abcDEF123\"", "fr", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything odd, and a column whose name clashes with common helpers."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumn("n", F.lit(None).cast("int")).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", n int")


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in ODD]
