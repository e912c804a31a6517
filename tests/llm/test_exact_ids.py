"""Token ids against a fresh tokenizer of the vocabulary file, with its own defaults."""

import random

import pytest
from tokenizers import Tokenizer
from variorum.llm import packing
from variorum.llm.tokens import CachedTokenizer, vocabulary_path

PATH = vocabulary_path()
FRESH = Tokenizer.from_file(PATH)


def want(texts):
    return [FRESH.encode(t or "", add_special_tokens=False).ids for t in texts]


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_special_strings_are_the_tokenizers():
    texts = ["a <|endoftext|> b", "<|startoftext|>x", "x<|ENDOFTEXT|>y", "a < | endoftext | > b", "plain", "it's <|endoftext|>", None]
    assert [x.tolist() for x in CachedTokenizer(PATH, 1 << 6).encode(texts)] == want(texts)


def test_special_strings_as_text():
    got = CachedTokenizer(PATH, 1 << 6, special_as_text=True).encode(["a <|endoftext|> b"])[0].tolist()
    assert got == [320, 27, 347, 40786, 4160, 91, 285, 321]


@pytest.mark.parametrize("n", [30, 32, 33, 64, 1024, 2048, 4096])
def test_words_that_share_a_polynomial_hash(n):
    texts = [thue_morse(n), thue_morse(n, "ba"), f"x {thue_morse(n)} y {thue_morse(n, 'ba')} z {thue_morse(n)}"]
    assert [x.tolist() for x in CachedTokenizer(PATH, 1 << 10).encode(texts)] == want(texts)


def test_equal_hashes_are_told_apart(monkeypatch):
    from variorum.llm import tokens

    monkeypatch.setattr(tokens, "_ODD", tokens._ODD * 0)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 40))) for _ in range(60)) for _ in range(20)]
    cached = CachedTokenizer(PATH, 1 << 10)
    assert [x.tolist() for x in cached.encode(texts)] == want(texts) == [x.tolist() for x in cached.encode(texts)]


def test_many_words_in_a_small_table():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 90))) for _ in range(80)]
    cached = CachedTokenizer(PATH, 1 << 7)
    for _ in range(2):
        assert [x.tolist() for x in cached.encode(texts)] == want(texts)


def test_packing_has_the_tokenizers_ids(spark):
    import zlib

    import numpy as np

    texts = ["a <|endoftext|> b", thue_morse(1500), thue_morse(1500, "ba"), "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(df, PATH, 4096, 1).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in enumerate(want(texts))}
