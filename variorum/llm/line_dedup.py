"""Removal of repeated multi-line passages by content-defined line chunks (operator 2).

Lines are hashed; a rolling hash over the last ``window`` line hashes ends a chunk after each line
where it is divisible by ``divisor``.  Where a chunk ends depends on the lines near it only, so a
passage that is moved, or stands between other lines, is cut at the same places.

Chunks of several lines that occur more than once in the corpus are removed, but for the first
occurrence (smallest id, then position).  First, counts by a 128-bit hash leave the repeated
hashes; then the chunks of those are grouped by their bytes, so a shared hash alone removes nothing.
Both counts are combined before they are shuffled, so a passage that stands in a third of all
documents is one row of each task; its occurrences meet what is known of it by hash and share of the
documents (``spread``), never in one task.

Only chunks with ``least_lines`` non-blank lines or more count.  Nulls: a null text stays null; rows
with a null id pass unchanged and don't count as occurrences.  Rows with the same id are one
document: a chunk they share isn't removed for that alone.  Texts are never shortened otherwise.  An
empty table gives an empty result; very long texts are cut into chunks whole.  Columns that have the
name of a result are replaced by it, other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import batches, out_batch, spread, table, written

CHUNKS = "_v_id long, _v_no int, _v_from int, _v_to int, _v_hash binary, _v_chunk string"
_CHUNKS = pa.schema([("_v_id", pa.int64()), ("_v_no", pa.int32()), ("_v_from", pa.int32()), ("_v_to", pa.int32()), ("_v_hash", pa.binary()), ("_v_chunk", pa.string())])
WINDOW, DIVISOR, FACTOR = 2, 4, 31


def line_hash(line: str) -> int:
    """32 bits of a line's MD5 (which SQL engines share)."""
    return int.from_bytes(hashlib.md5(line.encode(), usedforsecurity=False).digest()[:4], "big")


def cuts(lines: list[str], window: int = WINDOW, divisor: int = DIVISOR) -> list[int]:
    """The ends (exclusive) of the chunks of a text's lines."""
    hashes = list(map(line_hash, lines))
    out = []
    for i in range(len(lines)):
        rolling = sum(hashes[i - k] * FACTOR**k for k in range(min(window, i + 1)))
        if rolling % divisor == 0:
            out.append(i + 1)
    if not out or out[-1] != len(lines):
        out.append(len(lines))
    return out


def chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of several lines: id, number in the document, lines from and to (exclusive), hash, text."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "_v_text"):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                if doc is None or not text or "\n" not in text:
                    continue
                lines = text.split("\n")
                at = 0
                for no, stop in enumerate(cuts(lines, window, divisor)):
                    if stop - at >= least_lines and sum(1 for x in lines[at:stop] if x.strip(" ")) >= least_lines:
                        chunk = "\n".join(lines[at:stop])
                        rows.append((doc, no, at, stop, hashlib.md5(chunk.encode(), usedforsecurity=False).digest(), chunk))
                    at = stop
            if rows:
                yield out_batch(_CHUNKS, dict(zip(_CHUNKS.names, zip(*rows))))

    return docs.select(F.col(id_col).cast("long").alias("_v_id"), F.col(text_col).cast("string").alias("_v_text")).mapInArrow(cut, CHUNKS)


def repeated(found: DataFrame) -> DataFrame:
    """Occurrences (id, lines from and to) that are to go, of chunks equal to an earlier one."""
    common = found.groupBy("_v_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_v_hash")
    again = written(spread(found, common, ["_v_hash"], ["_v_id"]), "chunks")
    place = F.struct("_v_id", "_v_no")
    first = again.groupBy("_v_hash", "_v_chunk").agg(F.min(place).alias("_v_first"), F.max(place).alias("_v_last"))
    first = first.filter("_v_first != _v_last").drop("_v_last")
    return spread(again, first, ["_v_hash", "_v_chunk"], ["_v_id"]).filter(place != F.col("_v_first")).select("_v_id", "_v_from", "_v_to")


def dedup_lines(
    docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, least_lines: int = 2, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """``docs`` with repeated passages gone from the text, and the lines before and removed."""
    docs = docs.drop(*counts)
    found = written(chunks(docs, window, divisor, least_lines, id_col, text_col), "chunks-all")
    gone = repeated(found).groupBy("_v_id").agg(F.sort_array(F.collect_set(F.struct("_v_from", "_v_to"))).alias("_v_gone"))
    joined = docs.withColumn("_v_key", F.col(id_col).cast("long")).join(gone, F.col("_v_key") == F.col("_v_id"), "left").drop("_v_key", "_v_id")
    kept = docs.schema
    out = kept.fromJson(kept.jsonValue()).add(counts[0], "long").add(counts[1], "long")

    def remove(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            at, mark = whole.schema.get_field_index(text_col), whole.schema.get_field_index("_v_gone")
            for batch, texts in batches(iter([whole]), text_col):
                new, before, removed = [], [], []
                for text, spans in zip(texts, batch.column(mark).to_pylist()):
                    n = 0 if text is None else text.count("\n") + 1
                    less = 0
                    if spans and text is not None:
                        lines, left, start = text.split("\n"), [], 0
                        for s in spans:
                            left += lines[start : s["_v_from"]]
                            start = s["_v_to"]
                            less += s["_v_to"] - s["_v_from"]
                        text = "\n".join(left + lines[start:])
                    new.append(text)
                    before.append(n)
                    removed.append(less)
                columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != mark]
                names = [x for i, x in enumerate(batch.schema.names) if i != mark]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts])

    return joined.mapInArrow(remove, out)


PAIRS = "_v_id long, _v_at int, _v_hash binary, _v_pair string"
_PAIRS = pa.schema([("_v_id", pa.int64()), ("_v_at", pa.int32()), ("_v_hash", pa.binary()), ("_v_pair", pa.string())])


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each two non-blank lines of a text that follow each other (blank lines between them don't count)."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "_v_text", 1_000_000, 512):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                if doc is None or not text or "\n" not in text:
                    continue
                full = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" ")]
                for (i, x), (_, y) in zip(full, full[1:]):
                    pair = f"{x}\n{y}"
                    rows.append((doc, i, hashlib.md5(pair.encode(), usedforsecurity=False).digest(), pair))
            if rows:
                yield out_batch(_PAIRS, dict(zip(_PAIRS.names, zip(*rows))))

    return docs.select(F.col(id_col).cast("long").alias("_v_id"), F.col(text_col).cast("string").alias("_v_text")).mapInArrow(cut, PAIRS)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """As ``dedup_lines``, but for every run of two or more lines that stands earlier, wherever chunks end.

    A run is the union of its pairs of neighbouring lines, so the pairs that stand earlier (by id, then
    position) give each run to its ends, and no line goes without an equal one before it.  Blank lines
    inside a run go with it.
    """
    docs = docs.drop(*counts)
    found = written(pairs(docs, id_col=id_col, text_col=text_col), "pairs")
    common = found.groupBy("_v_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_v_hash")
    again = written(spread(found, common, ["_v_hash"], ["_v_id"]), "pairs-again")
    place = F.struct("_v_id", "_v_at")
    first = again.groupBy("_v_hash", "_v_pair").agg(F.min(place).alias("_v_first"))
    late = spread(again, first, ["_v_hash", "_v_pair"], ["_v_id"]).filter(place != F.col("_v_first"))
    gone = late.groupBy("_v_id").agg(F.sort_array(F.collect_set("_v_at")).alias("_v_gone"))
    joined = docs.withColumn("_v_key", F.col(id_col).cast("long")).join(gone, F.col("_v_key") == F.col("_v_id"), "left").drop("_v_key", "_v_id")
    kept = docs.schema
    out = kept.fromJson(kept.jsonValue()).add(counts[0], "long").add(counts[1], "long")

    def remove(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            at, mark = whole.schema.get_field_index(text_col), whole.schema.get_field_index("_v_gone")
            for batch, texts in batches(iter([whole]), text_col):
                new, before, removed = [], [], []
                for text, starts in zip(texts, batch.column(mark).to_pylist()):
                    lines = [] if text is None else text.split("\n")
                    less: set[int] = set()
                    for i in starts or ():
                        less.add(i)
                        j = i + 1
                        while j < len(lines) and not lines[j].strip(" "):
                            less.add(j)
                            j += 1
                        less.add(j)
                    new.append("\n".join(x for i, x in enumerate(lines) if i not in less) if less and text is not None else text)
                    before.append(len(lines))
                    removed.append(len(less))
                columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != mark]
                names = [x for i, x in enumerate(batch.schema.names) if i != mark]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], [*names, *counts])

    return joined.mapInArrow(remove, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_line_dedup``: all documents without passages that stand in an earlier one."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def chunk_sql(source: str = "documents", prefix: str = "") -> str:
    """DuckDB CTEs that end in {prefix}cleaned (doc_id, text, n_lines, n_removed)."""
    p = prefix
    return f"""
{p}lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM {source} WHERE text IS NOT NULL),
{p}hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM {p}lines),
{p}rolled AS (
  SELECT *, (h + {FACTOR} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {DIVISOR} = 0 AS ends FROM {p}hashed),
{p}numbered AS (
  SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM {p}rolled),
{p}chunked AS (
  SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n,
    count(*) FILTER (WHERE trim(line, ' ') <> '') AS full_lines FROM {p}numbered GROUP BY doc_id, no),
{p}firsts AS (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, no) AS nth FROM {p}chunked WHERE full_lines >= 2),
{p}gone AS (SELECT doc_id, no FROM {p}firsts WHERE nth > 1),
{p}left_over AS (
  SELECT n.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.no IS NULL) AS text,
    count(*) AS n_lines, count(g.no) AS n_removed
  FROM {p}numbered n LEFT JOIN {p}gone g ON n.doc_id = g.doc_id AND n.no = g.no GROUP BY n.doc_id),
{p}cleaned AS (
  SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(l.text, '') END AS text,
    coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_removed, 0) AS n_removed
  FROM {source} d LEFT JOIN {p}left_over l ON d.doc_id = l.doc_id)"""


ORACLE = f"WITH {chunk_sql()} SELECT doc_id, text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed FROM cleaned"
