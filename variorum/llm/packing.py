"""Best-fit-decreasing packing of token sequences (operator 5).

Documents become pieces of at most ``capacity`` tokens.  Best-fit decreasing places the longest
piece first, each into the open sequence with the least room that still takes it; a segment tree
over the remaining capacities finds that room in logarithmic time.

Which *document* has a given length doesn't matter for the number of sequences, so the plan is
made for the histogram of lengths: at most ``capacity`` rows, whatever the size of the corpus.
Pieces of equal length and open sequences of equal room are placed in runs.  A run is one line of
the plan; the pieces then look up their sequence and offset by their rank among the pieces of
their length.  Ranks come from counts for each (length, task), so that no task ever sorts or
holds all pieces of a length, however common it is.

Size of the plan: a length opens one range of new sequences and splits at most one range, so there
are at most ``2 * capacity`` ranges at any time, and each takes at most one run for each piece
that fits in a sequence.  Real plans have some tens of thousands of runs of 40 bytes.

Nulls: a null text is an empty document (one piece with the end token); a null id is kept.
Repeated rows are separate documents.  An empty table gives an empty result.  Very long texts are
encoded whole and cut into pieces.  Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import batches, out_batch, written
from .tokens import END_OF_TEXT, WORD_BPE, tokenizer, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
)


class RoomTree:
    """Segment tree over the rooms 0 to ``capacity``: how many ranges of open sequences have each."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that is there."""
        i = self.leaves + length
        if self.count[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i + (0 if self.count[2 * i] else 1)
                return i - self.leaves
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs of best-fit decreasing, and the number of sequences.

    A run (length, first rank, pieces in each sequence, first sequence, offset): ranks from the
    first on fill sequence after sequence, each with so many pieces from the offset on.
    """
    tree = RoomTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges (first sequence, number)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_[room].append((first, n))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = sequences, -(-left // each)
                sequences += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -1)
                each = room // length
                if n * each > left:
                    used = -(-left // each)
                    put(room, first + used, n - used)
                    n = used
            full = min(n, left // each)
            runs.append((length, rank, each, first, capacity - room))
            put(room - each * length, first, full)
            rest = left - full * each if n > full else 0
            put(room - rest * length, first + full, 1 if rest else 0)
            rank += full * each + rest
            left -= full * each + rest
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 5), sequences


def pieces(
    docs: DataFrame, path: str, capacity: int = 4096, end: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token pieces of the documents: ids, then ``end``; longer ones are cut at ``capacity``."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokenizer(path).encode, TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch, texts in batches(source, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = np.append(ids, end).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    rows.append((doc, k, at, len(piece), zlib.crc32(piece.tobytes()), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            yield out_batch(_PIECES, dict(zip(_PIECES.names, zip(*rows))))

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame, path: str, capacity: int = 4096, end: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` by best-fit decreasing."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end, id_col, text_col), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(runs)

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in source:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            length, rank = get("length"), get("nth") + get("before")
            at = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            k = rank - at[:, 1]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in _PIECES.names[:5]}
            yield out_batch(_PACKED, columns | {"sequence_id": pa.array(at[:, 3] + k // at[:, 2]), "offset": pa.array(at[:, 4] + k % at[:, 2] * length)})

    # the counts grow with tasks and lengths, so they are never broadcast
    return cut.join(counts.select("length", "part", "before").hint("merge"), ["length", "part"]).mapInArrow(place, PACKED)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PACKED = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Fixed value of the query: the id that ends a document.
QUERY_END = 1


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_best_fit_packing``: all documents in sequences of at most 4096 tokens."""
    from ._frames import table

    return pack(table(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE), 4096, QUERY_END)
