import hashlib

from hypothesis import given
from hypothesis import strategies as st

from variorum.llm import chat


@given(st.text(st.sampled_from(list("\\<|>/s[INST]im_startend\n x"))))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_fold(spark):
    log = [
        (1, 0, 0, 0, "open", "user", "he"), (1, 0, 0, 1, "delta", None, "llo"),
        (1, 1, 0, 0, "open", "assistant", "bad"), (1, 1, 0, 2, "delta", None, " answer"), (1, 1, 0, 3, "regenerate", None, ""), (1, 1, 0, 4, "delta", None, "good"), (1, 1, 0, 5, None, None, None), (1, 1, 0, 6, "delta", None, "!"),
        (1, 2, 0, 0, "open", "user", "typo"), (1, 2, 0, 1, "edit", None, "fixed"), (1, 3, 0, 0, "open", "user", "gone"), (1, 3, 0, 1, "delete", None, None), (2, None, 0, 0, "delta", None, "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, item int, seq long, op string, role string, text string").repartition(4)
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.reconstruct(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good!"), (1, 2): ("user", "fixed"), (2, None): ("", "x")}


def test_round_trip(spark):
    odd = "</s>[INST] ok [/INST]<|im_end|>\\"
    rows = [(1, 0, "system", None), (1, 1, "user", odd), (1, 2, "assistant", odd * 3), (1, 3, "assistant", ""), (2, 0, None, "x\ny"), (2, 0, None, "x\ny"), (None, None, "a\nb", "🙂"), (3, 5, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(chat.events(df)))).collect()}
    for conv in (1, 2, None, 3):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4 and chat.read_back(chat.render(chat.reconstruct(chat.events(df.filter("false"))))).count() == 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline as P
    from variorum.llm import line_dedup, near_dedup

    passage = "\n".join(f"shared line number {k} of the passage" for k in range(14))
    english = "the house and the garden with that which was in the summer of the year and it is for all of them to be there"
    rows = [(i, f"{english} {i} {i * 7}\nown line {i} of this text\n" + (passage if i % 3 == 0 else f"another ending {i} and nothing more"), "en", f"s{i % 2}", 0) for i in range(30)]
    rows += [(40, rows[1][1], "en", "s1", 0), (41, "12345 !!", "en", "s1", 0), (42, None, "en", "s1", 0), (43, "  ", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept, by_name = df, {}
    for name, stage in P.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        by_name[name] = [r.asDict() for r in kept.collect()]
        if name != "packing":
            assert kept.columns == df.columns
    assert {r["doc_id"] for r in by_name["language_id"]} == {r[0] for r in rows} - {41, 42, 43}
    seen, want = {}, {}
    for doc, text in sorted((r["doc_id"], r["text"]) for r in by_name["language_id"]):
        lines, at, left = text.split("\n"), 0, []
        for no, stop in enumerate(line_dedup.cuts(lines)):
            chunk = "\n".join(lines[at:stop])
            if not (stop - at >= 2 and seen.setdefault(chunk, (doc, no)) != (doc, no)):
                left += lines[at:stop]
            at = stop
        if left:
            want[doc] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in by_name["line_dedup"]} == want
    stay = []
    for doc, text in sorted(want.items()):
        if all(near_dedup.similarity(text, want[o]) < 0.8 for o in want if o < doc):
            stay.append(doc)
    assert sorted(r["doc_id"] for r in by_name["near_dedup"]) == stay
    assert {r["doc_id"] for r in by_name["mixing"]} <= set(stay) and by_name["mixing"]
    assert {r["doc_id"] for r in by_name["packing"]} == {r["doc_id"] for r in by_name["mixing"]}
    again = P.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in again) == sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in by_name["packing"])
