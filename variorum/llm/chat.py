"""Chat formatting by event-sourced reconstruction (operator 9).

A log holds events (conv_id, turn, item, seq, op, role, text).  ``open`` starts a message, ``delta``
appends streamed text, ``edit`` replaces the text, ``regenerate`` discards it and starts again,
``delete`` takes the message away.  Events are dealt by message and sorted by sequence, then folded
into final messages; events of one message never touch another, so a conversation that holds a third
of the log is folded by many tasks.  The messages are dealt by conversation, sorted by turn, and
rendered as a stream of fragments, one for each message, of which no task ever holds more than one
batch.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message.  Control strings inside texts get
a backslash after their first character and backslashes are doubled, so that no control string of
the template occurs in an escaped text and ``unescape`` gives back the text exactly.

Nulls: a null text or role is empty, a null op is ``delta``; null turns come first; rows of a null
conversation form one conversation.  Equal events (same message and sequence) are folded in the order
of their op, role and text.  A message without any event is none.  Equal rows of a table are messages of
their own; an empty log gives no message and no conversation.  Very long texts are escaped and read back
whole.  Only the named columns are read, so others can't clash.

A conversation's fragments are one stream, and its digest is of the stream in order: rendering and reading
back take one task a conversation, which holds one batch of it at a time (the sort before spills to disk).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import table

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_MESSAGE = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)

FRAGMENTS = "conv_id long, nth long, formatted string, loss_start long, loss_end long"
_FRAGMENTS = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """As ``escape``, and a line end becomes backslash, blank, n: a role is one line."""
    return escape(role).replace("\n", "\\ n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\( n|.)", lambda m: "\n" if m[1] == " n" else m[1], role, flags=re.S)


def events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 0) -> DataFrame:
    """The log that leads to the given messages: an ``open``, then the text as streamed deltas.

    By a hash of its key a message has a superseded draft first, which is regenerated, edited, or deleted
    and opened again; and beside one in eight a message stood that was deleted (items below 0).

    Rows with equal conversation and turn are messages of their own (``item``).  ``chunk`` is the
    number of characters of a delta; 0 streams a text in two halves.
    """
    item = F.row_number().over(Window.partitionBy(conv, turn).orderBy(role, text)) - 1
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = F.greatest(F.lit(1), F.ceil(F.length(whole) / 2).cast("int")) if not chunk else F.lit(chunk)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(whole) - 1) / size).cast("int"))), lambda k: F.substring(whole, k * size + 1, size))
    log = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), item.cast("int").alias("item"), F.col(role).cast("string").alias("role"), parts.alias("_parts"))
    event = lambda op, x: F.struct((op if isinstance(op, Column) else F.lit(op)).alias("op"), x.alias("text"))
    part, draft, none = F.col("_parts"), F.reverse(F.get("_parts", F.lit(0))), F.lit(None).cast("string")
    told = lambda first: F.transform(part, lambda x, k: event(F.when(k == 0, F.lit(first)).otherwise(F.lit("delta")), x))
    opened = F.array(event("open", draft))
    streamed = F.array(event("open", draft), event("delta", draft))
    kind = F.pmod(F.xxhash64("conv_id", "turn", "item"), F.lit(8))
    way = (
        F.when(kind == 1, F.concat(streamed, F.array(event("regenerate", F.lit(""))), told("delta")))
        .when(kind == 2, F.concat(opened, told("edit")))
        .when(kind == 3, F.concat(opened, F.array(event("delete", none)), told("open")))
        .otherwise(told("open"))
    )
    gone = F.when(kind == 4, F.concat(streamed, F.array(event("delete", none))))
    both = F.array(F.struct(F.col("item").alias("item"), way.alias("e")), F.struct((-1 - F.col("item")).alias("item"), gone.alias("e")))
    messages = log.select("conv_id", "turn", "role", F.explode(both).alias("_m")).select("conv_id", "turn", F.col("_m.item").alias("item"), "role", F.col("_m.e").alias("_e"))
    return messages.select("conv_id", "turn", "item", "role", F.posexplode("_e").alias("_k", "_x")).select(
        "conv_id", "turn", "item", F.col("_k").cast("long").alias("seq"), F.col("_x.op").alias("op"), "role", F.col("_x.text").alias("text")
    )


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, item, role, text) of an event log."""
    one = F.struct("seq", F.coalesce("op", F.lit("delta")).alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"))
    folded = log.groupBy("conv_id", "turn", "item").agg(F.sort_array(F.collect_list(one)).alias("e"))
    resets = F.array_max(F.transform("e", lambda x, i: F.when(x["op"].isin("open", "edit", "regenerate", "delete"), i).otherwise(F.lit(-1))))
    folded = folded.withColumn("at", resets)
    after = F.expr("slice(e, greatest(at, 0) + 1, size(e))")
    roles = F.filter("e", lambda x: x["role"].isNotNull())
    return (
        folded.filter((F.col("at") < 0) | (F.expr("get(e, at).op") != "delete"))
        .select("conv_id", "turn", "item", F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).otherwise("").alias("role"), F.array_join(F.transform(after, lambda x: x["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """Fragments in the order of their conversation: formatted text, and the span in it that is trained
    on (the assistant's text, in code points of the fragment; nulls for other roles).

    Fragments of a conversation stay together and in order in one partition.
    """

    def fragments(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nth = object(), 0
        for batch in source:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                nth, current = (nth + 1, current) if conv == current else (0, conv)
                head = START + escape_role(role or "") + "\n"
                body = escape(text or "")
                trained = role == "assistant"
                out.append((conv, nth, head + body + END + "\n", len(head) if trained else None, len(head) + len(body) if trained else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FRAGMENTS)], schema=_FRAGMENTS)

    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "item", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(fragments, FRAGMENTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(fragments: DataFrame) -> DataFrame:
    """Parse rendered fragments (as ``render`` leaves them) and digest each conversation."""

    def digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def row() -> tuple:
            n, turns, chars, loss, total = state
            return current, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in source:
            out: list[tuple] = []
            for conv, text, start, stop in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if state is None or conv != current:
                    if state is not None:
                        out.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = _MESSAGE.fullmatch(text)
                if not found:
                    raise ValueError(f"conversation {conv} has a fragment that isn't one message")
                role, body = unescape_role(found[1]), unescape(found[2])
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                state[4] += len(text)
                if start is not None:
                    trained = unescape(text[start:stop])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGESTS)], schema=_DIGESTS)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row(), _DIGESTS)], schema=_DIGESTS)

    return fragments.mapInArrow(digest, DIGESTS)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, and conversation -1, whose texts are full of control strings."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.unionByName(extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_chat_formatting``: all conversations from their event logs, formatted and read back."""
    return read_back(render(reconstruct(events(conversations(spark, sf_dir)))))


def _oracle() -> str:
    def escaped(what: str) -> str:
        pattern = "|".join(re.sub(r"([\[\]|])", r"\\\1", c[0]) + "(" + re.sub(r"([\[\]|])", r"\\\1", c[1:]) + ")" for c in CONTROL)
        extra = f"len(regexp_extract_all({what}, '{pattern}'))"
        return f"(length({what}) + length({what}) - length(replace({what}, '\\', '')) + {extra})"

    frame = len(START) + len(END) + 2
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum({frame} + {escaped('role')} + 2 * (length(role) - length(replace(role, chr(10), ''))) + {escaped('text')}) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars FROM told"""


ORACLE = _oracle()
