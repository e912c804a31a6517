"""Large buckets, hubs and common texts of near dedup, against all pairs."""

import random

import pytest
from test_documents import edited, plain_classes
from variorum.llm import near_dedup


@pytest.mark.parametrize("block, hot", [(8, 10_000), (8, 3), (64, 3)])
def test_large_buckets_lose_no_link(spark, monkeypatch, block, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rng = random.Random(block)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    rows = []
    for k in range(90):  # a cloud around one text: chains of links, some texts are near the hub and others not
        rows.append((k, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 3])))))
    other = [f"v{rng.randrange(300)}" for _ in range(60)]
    rows += [(100 + k, " ".join(edited(rng, other, 1))) for k in range(30)] + [(200 + k, " ".join(base)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs, block=block).collect()}
    assert got == plain_classes(rows)


def test_long_texts_count_by_their_length(spark, monkeypatch):
    """Few long texts of one bucket are dealt like many short ones, with the same classes."""
    rng, linked, calls = random.Random(3), near_dedup._linked, []
    monkeypatch.setattr(near_dedup, "LONG", 16)
    monkeypatch.setattr(near_dedup, "_linked", lambda *a: calls.append(1) or linked(*a))
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([0, 2, 5, 9, 12])))) for k in range(30)] + [(90 + k, f"a b c d e f {k // 2}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs, block=64).collect()}
    assert got == plain_classes(rows) and calls


def test_a_bucket_keeps_few_shingles(monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    texts = sorted({" ".join(edited(rng, base, rng.choice([0, 2, 5, 9, 12]))) for _ in range(40)})
    rows = [(b"%03d" % k, b"%03d" % k, 196, 0, 0, [], bytes(192), t) for k, t in enumerate(texts)]
    whole = list(near_dedup._Bucket(rows, 0, 0.8, 5).links())
    monkeypatch.setattr(near_dedup, "KEPT", 1000, raising=False)
    held = near_dedup._Bucket(rows, 0, 0.8, 5)
    most = 0
    for n, link in enumerate(held.links()):
        most = max(most, sum(map(len, held.bags.values())))
        assert link == whole[n]
    assert n + 1 == len(whole) and 10 < len(whole) < len(rows) and most <= 1000


def test_forgotten_texts_are_signed_again(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_REMEMBERED", 2)
    rows = [(i, f"a b c d e f g h {i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == plain_classes(rows)


def test_a_clashing_column_passes_by(spark):
    rows = [(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (None, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, tid string")
    assert sorted(map(tuple, near_dedup.near_classes(docs).collect()), key=str) == [(1, 1), (2, 1), (None, None)]


def true_pairs(texts, threshold=0.8):
    """All pairs of different texts that are as similar, through the rarest shingles of each (none is lost)."""
    bags = [near_dedup.bag(t) for t in texts]
    often = {}
    for b in bags:
        for s, n in b.items():
            often[s] = often.get(s, 0) + n
    held, found = {}, []
    for i, b in enumerate(bags):
        each = sorted(((often[s], s, k) for s, n in b.items() for k in range(n)))
        seen = set()
        for _, s, k in each[: len(each) - int(-(-threshold * len(each) // 1)) + 1]:
            seen.update(held.get((s, k), ()))
            held.setdefault((s, k), []).append(i)
        found += [(j, i) for j in seen if near_dedup._jaccard(bags[j], b) >= threshold]
    return found


def test_recall_on_a_whole_table(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect() if r["text"] and near_dedup.bag(r["text"])]
    first = {}
    for r in rows:
        first.setdefault(r["text"], r["doc_id"])
    texts = list(first)
    pairs = true_pairs(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.query(spark, "/root/testdata/sf0.01").collect()}
    caught = sum(got[first[texts[i]]] == got[first[texts[j]]] for i, j in pairs)
    assert pairs and caught >= 0.999 * len(pairs)
    assert all(got[r["doc_id"]] == got[first[r["text"]]] for r in rows)
