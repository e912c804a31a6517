"""End marks, many magics in one value, and what the query reads back, against plain computations."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import pytest
from variorum.llm import media


@pytest.mark.parametrize("part", [b"%PDF-1", b"PK\x03\x04", b"\xff\xd8\xff\xda", b"GIF89a0000!00,,", b"\x1f\x8b\x08", b"BM", b"RIFF"])
def test_values_full_of_magics_cost_their_length(part):
    data = part * (3_000_000 // len(part))
    start = time.time()
    assert media.sniff(data) == (None, [])
    assert time.time() - start < 20


def test_end_marks_are_found_like_a_search():
    rng = random.Random(1)
    for _ in range(200):
        data = b"".join(rng.choice([b"%PDF-1", b"%%EOF", b"startxref", b"PK\x05\x06", b"xx", b"%"]) for _ in range(30))
        marks = {}
        for m in media.END_MARKS:
            marks[m] = [i for i in range(len(data)) if data.startswith(m, i)]
        v = media.Value(data, marks)
        for m in media.END_MARKS:
            at, stop = rng.randrange(len(data)), rng.randrange(len(data) + 1)
            assert v.find(m, at) == data.find(m, at) and v.find(m, at, stop) == (data.find(m, at, stop) if stop >= at else -1)


def test_pdf_zip_and_gzip():
    import io
    import zipfile

    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    packed = zlib.compressobj(9, wbits=31)
    gz = packed.compress(bytes(5_000_000)) + packed.flush()
    data = b"junk" + pdf + b"--" + box.getvalue() + b"--" + gz + b"tail"
    at = [4, 4 + len(pdf) + 2]
    at.append(at[1] + len(box.getvalue()) + 2)
    assert media.sniff(data) == (None, [("pdf", at[0], len(pdf)), ("zip", at[1], len(box.getvalue())), ("gzip", at[2], len(gz))])
    assert media.sniff(gz) == ("gzip", []) and media.sniff(gz[:-3]) == (None, [])


def test_features_of_the_stored_form(odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in media.inspect(media.store_texts(odd), read=True).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        kind = media.KINDS[len(raw) % 4]
        stored = media.store(payload, kind)
        counts = Counter(payload)
        entropy = -sum(n / len(payload) * math.log2(n / len(payload)) for n in counts.values())
        mean = sum(payload) / len(payload)
        assert (r["actual"], r["media_bytes"], r["media_sha256"]) == (kind, len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == f"{kind};embedded={len(r['embedded'])};mean={mean:.4f};entropy={abs(entropy):.4f};distinct={len(counts)}" or entropy == 0
