"""The pipeline's last stages against plain versions, and odd tables."""

import random
import zlib

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from variorum.llm import mixing
from variorum.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=160):
    rng = random.Random(12)
    words = {"en": ["the", "and", "house", "with", "that", "which", "was"], "de": ["und", "der", "haus", "mit", "dass", "welche", "war"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", str(rng.randrange(900))]) for _ in range(rng.randint(5, 90))) + rng.choice(["", "", "!!", " | x"])
        rows.append((i, text, lang, rng.choice("aaab"), len(text)))
    return rows


def plain_draw(rows):
    """Cells, capped raking and the draw, by their definitions."""
    import hashlib
    import re

    def topic(t):
        return "table" if " | " in t else "shouting" if "!!" in t else "contact" if "@" in t or "http" in t else "long" if len(t) > 4000 else "prose"

    told = [(r["doc_id"], (r["source"] or "", r["lang"] or "", topic(r["text"])), len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in rows]
    cells = {}
    for _, key, n in told:
        cells[key] = cells.get(key, 0) + n
    keys = sorted(cells)
    drawn = mixing.rake_capped(keys, np.array([cells[k] for k in keys]), [mixing.TARGETS[d] for d in mixing.DIMS], mixing.KEEP)
    chance = {k: round(min(1.0, x / cells[k]), 6) for k, x in zip(keys, drawn)}
    u = lambda i: int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
    return sorted(i for i, key, _ in told if u(i) < chance[key])


def test_mixing_and_packing_are_the_plain_ones(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    before = P.one_of_each(spark, docs, str(tmp_path)).collect()
    mixed = P.mix_sources(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in mixed) == plain_draw(before) and 20 < len(mixed) < len(before)
    rows = P.run(spark, str(tmp_path)).collect()
    fresh = Tokenizer.from_file(vocabulary_path())
    want, used = {}, {}
    for r in mixed:
        ids = np.array([*fresh.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], k] = len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())
    assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in rows} == want
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(used) == -(-sum(n for n, _ in want.values()) // 4096)


def test_an_empty_table_and_further_columns(spark, tmp_path):
    rows = spark.createDataFrame(corpus(40), SCHEMA)
    clash = rows.withColumns({c: F.lit("own") for c in ("lang_pred", "score", "root", "tid", "key", "n", "class_id", "tokens", "label")})
    for folder, df in (("empty", clash.filter("false")), ("clash", clash.unionByName(clash.limit(5)))):
        df.write.parquet(str(tmp_path / folder / "documents.parquet"))
        docs = df
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path / folder))
            assert docs.columns == df.columns
            if folder == "clash":
                assert docs.filter("lang_pred != 'own' or score != 'own' or tid != 'own' or label != 'own'").count() == 0
        assert P.run(spark, str(tmp_path / folder)).count() == 0 if folder == "empty" else docs.count() > 0


def test_marginals_off_target_are_told():
    import warnings

    keys, tokens = [("a", "x"), ("b", "y"), ("a", "y")], np.array([10, 20, 30])
    fitted = mixing.rake(keys, tokens, [0.5, 0.5], 200)
    assert mixing.off_target(keys, tokens, tokens.astype(float), [0.5, 0.5]) > 0.1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert mixing.off_target(keys, tokens, fitted, [0.5, 0.5]) >= 0
