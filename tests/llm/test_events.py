from variorum.llm import chat


def test_the_log_has_every_operation(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} of {t}" if (c + t) % 9 else None) for c in range(40) for t in range(6)]
    log = chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).cache()
    ops = {r["op"]: r["count"] for r in log.groupBy("op").count().collect()}
    assert set(ops) == {"open", "delta", "edit", "regenerate", "delete"} and min(ops.values()) > 10
    got = {(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.reconstruct(log).collect()}
    assert got == {(c, t, r, x or "") for c, t, r, x in rows}
