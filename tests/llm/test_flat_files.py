"""Flat token files read by ranges, and the scan in two levels."""

import random

import numpy as np
import pytest
from variorum.llm import token_counts


def plain(ids, mark=7):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == mark:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_ranges_and_levels(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    rng = random.Random(group)
    want = {}
    for name, n, marks in (("a", 900, [7]), ("b", 333, [7, 7, 7]), ("c", 0, []), ("d", 64, []), ("e", 500, [])):
        ids = [rng.choice([1, 2, 3, 4, 5, *marks]) for _ in range(n)]
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        want[name] = plain(ids)
    blocks = token_counts.read_flat_files(spark, str(tmp_path), 32, 128)
    assert blocks.count() == sum(-(-2 * n // 32) for n in (900, 333, 0, 64, 500)) and blocks.filter("octet_length(data) > 32").count() == 0
    got = {}
    for r in token_counts.scan_separators(blocks, 7).collect():
        got.setdefault(r["file"].split("/")[-1][0], []).append((r["nth"], r["start"], r["n_tokens"], r["closed"]))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_separators_as_text(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "c")], "doc_id long, text string")
    from variorum.llm.tokens import vocabulary_path

    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, vocabulary_path(), block_tokens=3).collect()}
    assert got == {1: 8, 2: 1}
