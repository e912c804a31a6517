"""Token counts of documents in flat token files without an index (operator 1).

A flat token file is one run of fixed-width token ids in which an end-of-document id closes each
document; blocks cut it at fixed sizes, anywhere.  Each block is searched on its own with one
vectorised comparison.  A document may begin in one block and end many blocks later: an exclusive
prefix scan over the blocks of a file (tokens, documents and the last boundary before each) turns
positions in blocks into positions in the file and stitches the documents together.

The scan sees four numbers of each block, in two levels (groups of blocks, then blocks of a group), so
one huge file is no single task; boundaries join it by block afterwards, tokens never move.  Files may
differ in size by any factor: they are read by ranges, and the blocks are spread over tasks whatever
their file.

Defined results: a file that doesn't end with the separator has a last document with
``closed = false``; two separators in a row enclose a document of no tokens; an empty file, or one
of empty blocks, has no document.  Null texts are documents of no tokens; null ids are kept, repeated
rows are documents of their own, very long texts go over many blocks, and an empty table gives an empty
result.  Special strings inside texts are spelled out, so no text holds a separator.  Only the id and the
text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import batches, out_batch, table, written
from .tokens import END_OF_TEXT, WORD_BPE, tokenizer, vocabulary_path

BLOCKS = "file string, block long, data binary, doc_ids array<long>"
_BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
_ENDS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])


def token_blocks(
    docs: DataFrame, path: str, separator: int = END_OF_TEXT, block_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Flat token files, one for each partition of ``docs``, in blocks of 16-bit ids.

    ``doc_ids`` are the documents that began in the block, in order: a manifest beside the tokens,
    which the separator scan doesn't read.
    """

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, name = tokenizer(path, special_as_text=True).encode, f"part-{TaskContext.get().partitionId():06d}"
        size, block = 2 * block_tokens, 0
        pending, docs_in = bytearray(), []
        mark = np.array([separator], "<u2").tobytes()
        for batch, texts in batches(source, "text"):
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(texts)):
                docs_in.append(doc)
                pending += ids.astype("<u2").tobytes()
                pending += mark
                while len(pending) >= size:
                    yield out_batch(_BLOCKS, {"file": [name], "block": [block], "data": [bytes(pending[:size])], "doc_ids": [docs_in]})
                    del pending[:size]
                    block, docs_in = block + 1, []
        if pending:
            yield out_batch(_BLOCKS, {"file": [name], "block": [block], "data": [bytes(pending)], "doc_ids": [docs_in]})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(encode, BLOCKS)


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = 1 << 17, range_bytes: int = 1 << 27) -> DataFrame:
    """Blocks of flat token files, whose sizes may differ by any factor: files are listed without their content
    and cut into ranges of ``range_bytes`` (or a little less: whole blocks), each read by a task of its own.

    Ranges are read by Arrow's file systems (local, s3, gs, abfs, hdfs).  Files of any other store are read whole
    by Spark, one task a file of at most 2 GB."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    range_bytes = max(1, range_bytes // block_bytes) * block_bytes
    known = F.lower(F.regexp_extract("path", "^([A-Za-z0-9]+):", 1)).isin("", "file", "s3", "s3a", "gs", "abfs", "abfss", "hdfs")
    ranged = listed.filter(known & (F.col("length") > 0)).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("at"))

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in source:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where = name.replace("s3a:", "s3:", 1) if name.startswith("s3a:") else name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name
                system, place = fs.FileSystem.from_uri(where)
                with system.open_input_file(place) as f:
                    f.seek(at)
                    for k in range(at // block_bytes, (at + range_bytes) // block_bytes):
                        data = f.read(block_bytes)
                        if not data:
                            break
                        yield out_batch(_BLOCKS, {"file": [name], "block": [k], "data": [data], "doc_ids": [None]})

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                for k, at in enumerate(range(0, len(data), block_bytes)):
                    yield out_batch(_BLOCKS, {"file": [name], "block": [k], "data": [bytes(data[at : at + block_bytes])], "doc_ids": [None]})

    parts = ranged.select("path", "at").repartition("path", "at").mapInArrow(read, BLOCKS)
    if listed.filter(~known).isEmpty():
        return parts
    return parts.unionByName(spark.read.format("binaryFile").load(path).filter(~known).select("path", "content").mapInArrow(cut, BLOCKS))


#: Blocks of a file whose prefixes one task scans; the next level scans a row for each such group.
GROUP = 4096


def before(rows: DataFrame, value: str, out: str, highest: bool = False) -> DataFrame:
    """``rows`` (file, block, ...) with the exclusive prefix sum (or greatest value) of ``value`` over the blocks
    of their file, in two levels: over groups of ``GROUP`` blocks, then within each group."""
    op = F.max if highest else F.sum
    grouped = rows.withColumn("_g", F.floor(F.col("block") / GROUP))
    first = Window.partitionBy("file").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("file", "_g").agg(op(value).alias("_v")).select("file", "_g", op("_v").over(first).alias("_before"))
    own = op(value).over(Window.partitionBy("file", "_g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("long")
    both = F.greatest(F.coalesce("_before", zero), F.coalesce(own, zero)) if highest else F.coalesce("_before", zero) + F.coalesce(own, zero)
    return grouped.join(groups, ["file", "_g"]).withColumn(out, both).drop("_g", "_before")


def scan_separators(blocks: DataFrame, separator: int = END_OF_TEXT, dtype: str = "<u2") -> DataFrame:
    """Documents of flat token files: (file, nth, start, n_tokens, closed), separators not counted."""

    def search(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in source:
            n, ends = [], []
            for data in batch.column(2):
                buffer = data.as_buffer()
                if buffer is not None and buffer.size % width:
                    raise ValueError(f"a block of {buffer.size} bytes doesn't hold whole ids of {width} bytes")
                ids = np.frombuffer(buffer, dtype) if buffer is not None and buffer.size else np.zeros(0, dtype)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == separator) + 1)
            yield out_batch(_ENDS, {"file": batch.column(0), "block": batch.column(1), "n": n, "ends": ends})

    found = written(blocks.select("file", "block", "data").mapInArrow(search, "file string, block long, n long, ends array<long>"), "ends")
    # the prefix scan sees four numbers of each block; the boundaries join it by block afterwards
    light = found.select("file", "block", "n", F.size("ends").cast("long").alias("m"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("_end"))
    scanned = before(before(light, "n", "base"), "m", "nth").withColumn("final", F.col("base") + F.col("_end"))
    scanned = before(scanned, "final", "carry", highest=True)
    scanned = written(scanned.select("file", "block", "n", "m", "base", "nth", "final", "carry"), "scanned")
    met = found.filter(F.size("ends") > 0).select("file", "block", "ends").join(scanned.select("file", "block", "base", "nth", "carry"), ["file", "block"])
    closed = met.select("file", "base", "nth", "carry", "ends", F.posexplode("ends").alias("k", "end")).select(
        "file",
        (F.col("nth") + F.col("k")).alias("nth"),
        F.when(F.col("k") == 0, F.col("carry")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1)).alias("start"),
        (F.col("base") + F.col("end")).alias("stop"),
    )
    closed = closed.select("file", "nth", "start", (F.col("stop") - F.col("start") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    # what stands after the last separator of a file
    files = scanned.groupBy("file").agg(F.sum("n").alias("n"), F.sum("m").alias("nth"), F.coalesce(F.max("final"), F.lit(0).cast("long")).alias("start"))
    rest = files.filter("n > start").select("file", "nth", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def manifest(blocks: DataFrame) -> DataFrame:
    """(file, nth, doc_id): which document is the nth of a file, from the blocks' manifests."""
    light = blocks.select("file", "block", F.size("doc_ids").cast("long").alias("_n"))
    first = before(light, "_n", "first").select("file", "block", "first")
    told = blocks.filter(F.size("doc_ids") > 0).select("file", "block", "doc_ids").join(first, ["file", "block"])
    return told.select("file", F.posexplode("doc_ids").alias("k", "doc_id"), "first").select("file", (F.col("first") + F.col("k")).alias("nth"), "doc_id")


def token_counts(docs: DataFrame, path: str, separator: int = END_OF_TEXT, block_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, file, nth, start, closed) of documents, by way of flat token files."""
    blocks = written(token_blocks(docs, path, separator, block_tokens, id_col, text_col), "tokens")
    return scan_separators(blocks, separator).join(manifest(blocks), ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth", "start", "closed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_token_counts``: tokens of every document by a separator scan."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE))
