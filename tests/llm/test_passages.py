"""Whole runs of repeated lines, against brute force over all pairs of neighbouring lines."""

import random

from variorum.llm import line_dedup


def plain_passages(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        keys = list(zip(lines, lines[1:]))
        gone = set()
        for i, k in enumerate(keys):
            if k in seen:
                gone |= {i, i + 1}
            seen.add(k)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_repeated_passages_go_to_their_ends(spark):
    rng = random.Random(5)
    passages = [[f"line {p} {k} {rng.random()}" for k in range(rng.randint(2, 4))] for p in range(8)]
    rows = []
    for i in range(60):
        own = [f"own {i} {k}" for k in range(rng.randint(0, 4))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + rng.choice(passages) + own[at:])))
    rows += [(60, "a\na\na\na"), (61, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_passages(docs).collect()}
    assert got == plain_passages(rows) and got[61] == ""
    texts = list(got.values())
    assert all(sum(x in t for t in texts) == 1 for p in passages for x in p if any(x in t for _, t in rows))


def test_odd_rows_pass(spark, odd, none):
    back = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_passages(odd).collect()}
    assert {(None, "An id is missing here, but the text is not."), (2, None), (3, "")} <= back
    assert line_dedup.dedup_passages(none).count() == 0
    one = spark.createDataFrame([(1, "p\n\nq\nown"), (2, "x\np\n\nq"), (None, "p\nq")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_passages(one).collect()}
    assert got == {1: ("p\n\nq\nown", 4, 0), 2: ("x", 4, 3), None: ("p\nq", 2, 0)}
