from pyspark.sql import functions as F
from variorum.llm import secrets


def test_copies_of_a_text_are_one_holder_and_repositories_count(spark):
    live, shared, spread = "Zz9" + "q1W2" * 8, "Ex4mple" + "a1B2" * 8, "Sp4" + "c3D4" * 8
    rows = [(1, f"see {live} here", "s1", "en"), (2, f"see {live} here", "s2", "de"), (3, f"one {shared}", "s1", "en"), (4, f"two {shared}", "s2", "en")]
    rows += [(5, f"one {spread}", "s1", "en"), (6, f"two {spread}", "s1", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = {r["doc_id"]: len(r["added"]) for r in secrets.scan(docs, repository=F.concat_ws("/", "source", "lang")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}
