import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from variorum.llm import packing, token_counts
from variorum.llm.tokens import CachedTokenizer, vocabulary_path

PATH = vocabulary_path()
TOKENIZER = CachedTokenizer(PATH, 1 << 6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_cached_ids_are_the_tokenizers(texts):
    want = [TOKENIZER.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in TOKENIZER.encode(texts)] == want


def test_special_strings_and_nulls():
    texts = ["<|endoftext|> it's", None, "", "A\u0301 ÀÉ ß 12½", "İΣς"]
    want = [TOKENIZER.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in TOKENIZER.encode(texts)] == want


def first_best_fit(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i == len(rooms):
            n += 1
            rest = capacity - x
        else:
            rest = rooms.pop(i) - x
        bisect.insort(rooms, rest)
    return n


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 256])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 1 + capacity // 5)]) for _ in range(rng.randint(0, 400))]
    hist = {}
    for x in lengths:
        hist[x] = hist.get(x, 0) + 1
    runs, n = packing.plan(hist, capacity)
    assert n == first_best_fit(lengths, capacity)
    used = {}
    for x, count in hist.items():
        mine = runs[runs[:, 0] == x]
        for rank in range(count):
            _, first, each, seq, offset = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
            used.setdefault(int(seq + (rank - first) // each), []).append((int(offset + (rank - first) % each * x), x))
    for parts in used.values():
        at = 0
        for offset, x in sorted(parts):
            assert offset == at
            at += x
        assert at <= capacity
    assert len(used) == n


def test_pack(odd, none):
    rows = packing.pack(odd, PATH, 64, 1).toPandas()
    ids = {}
    for r in odd.select("doc_id", "text").collect():
        ids.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, np.array([*TOKENIZER.whole.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
    assert len(rows) == sum(-(-len(ids[k]) // 64) * (2 if k == 9 else 1) for k in ids)
    for r in rows.itertuples():
        doc = ids[-1 if r.doc_id != r.doc_id else int(r.doc_id)]
        piece = doc[r.start : r.start + 64]
        assert (r.piece * 64, r.length, r.ids_crc32) == (r.start, len(piece), zlib.crc32(piece.tobytes()))
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert rows.sequence_id.nunique() == first_best_fit(rows.length.tolist(), 64)
    assert packing.pack(none, PATH, 64, 1).count() == 0


def test_token_counts(odd, none):
    for block in (4, 1 << 16):
        got = token_counts.token_counts(odd, PATH, block_tokens=block).collect()
        want = sorted((str(r["doc_id"]), len(TOKENIZER.whole.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want and all(r["closed"] for r in got)
    assert token_counts.token_counts(none, PATH).count() == 0


def test_scan_stitches_any_blocks(spark, tmp_path):
    rng = random.Random(1)
    ids = [rng.choice([7, 7, 1, 2, 3]) for _ in range(200)] + [5, 5]
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 7:
            want.append((start, i - start, True))
            start = i + 1
    want.append((start, len(ids) - start, False))
    (tmp_path / "f.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "g.bin").write_bytes(b"")
    for size in (2, 10, 1000):
        blocks = token_counts.read_flat_files(spark, str(tmp_path), size)
        got = sorted((r["start"], r["n_tokens"], r["closed"]) for r in token_counts.scan_separators(blocks, 7).collect())
        assert got == sorted(want)
