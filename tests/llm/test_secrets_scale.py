"""Secrets in long texts, at odd places, and of common values."""

import random
import re
import time

from variorum.llm import secrets
from variorum.llm._frames import spread

from test_documents import plain_spans


def test_a_long_text_with_many_matches_takes_seconds(spark):
    rng = random.Random(1)
    parts = []
    for k in range(60_000):
        parts.append(rng.choice([f'token = "abc{k}def{k}"', "q1w2" * 5 + f"Z{k}z", f"{rng.getrandbits(128):032x}", "plain words \u00e9\U0001f642"]))
    text = " ".join(parts)
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    start = time.time()
    row = secrets.scan(docs).first()
    assert len(text) > 1_200_000 and time.time() - start < 60
    assert [(secrets.KINDS[x["kind"]], x["start"], x["end"]) for x in row["base"]] == plain_spans(text)
    want = plain_other(text)
    assert [(x["start"], x["end"]) for x in row["added"]] == want and len(want) > 5_000


def plain_other(text):
    base = [(a, b) for _, a, b in plain_spans(text)]
    out, at, upto = [], 0, 0
    for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text):
        while at < len(base) and base[at][0] < m.end():
            upto = max(upto, base[at][1])
            at += 1
        turns = len(re.findall("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]", m[0]))
        if turns >= secrets.TURNS and upto <= m.start():
            out.append((m.start(), m.end()))
    return out


def test_spans_and_verdicts_of_many_texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        parts = [rng.choice(["Ab1" * 6, "x9" * 10, f"K{i}b7Q{i}c8Z{i}d9e0f", "password: hunter2x", "some words", "token=" + "ab12" * 9, f"{rng.getrandbits(96):024x}"]) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts), f"s{i % 7}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    held = {}
    for text in {t for _, t, _ in rows}:
        source = min(s for _, t, s in rows if t == text)
        values = {text[a:b] for a, b in plain_other(text)} | {m[2] for m in re.finditer(secrets.ASSIGN.replace("(?i:", "(").replace("\\x20", " "), text, re.I) if len(m[2]) >= 6} | {m[0] for m in re.finditer("[0-9a-f]{24,}", text)}
        for v in values:
            held.setdefault(v, set()).add(source)
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    for i, text, _ in rows:
        assert [(secrets.KINDS[x["kind"]], x["start"], x["end"]) for x in got[i]["base"]] == plain_spans(text)
        assert [(x["start"], x["end"]) for x in got[i]["added"]] == [(a, b) for a, b in plain_other(text) if len(held[text[a:b]]) < 2]
        assert len(got[i]["verdicts"]) == got[i]["n_live"] + got[i]["n_example"] and all(x["live"] == (x["owners"] < 2) for x in got[i]["verdicts"])


def test_spread_is_a_join(spark):
    rows = spark.createDataFrame([(k, i) for i in range(500) for k in ("hot", f"k{i % 9}")], "key string, i int")
    facts = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "key string, f int")
    got = sorted((r["key"], r["i"], r["f"]) for r in spread(rows, facts, ["key"], ["i"]).collect())
    known = {"hot": 1, "k3": 2}
    assert got == sorted((k, i, known[k]) for k, i in map(tuple, rows.collect()) if k in known)
