"""Language identification by rank-order profiles (operator 3).

A profile is the list of a text's most frequent character n-grams, most frequent first.  The
distance of a document to a language sums, over the document's profile, how far each n-gram is out
of place in the language's profile; an n-gram that isn't there counts as ``size`` places.  The
nearest language wins, the first in alphabetical order on a tie.

Letters are lower-cased, everything else becomes one blank, and words are padded with blanks.
Languages are learned from at most ``sample`` labelled texts of each (those of the smallest hash of
id and text; rows equal in both are one), a bound on what is learned from, not on what is predicted.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null label teach
nothing, rows with a null id teach.  Without any labelled text (as in an empty table), all texts are
``und``.  Repeated rows are predicted alike; very long texts are counted whole.  Columns that have the
name of a result are replaced by it, unless ``names`` gives the results other names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._frames import FEW, batches, table, written

UNDETERMINED = "und"
#: Most languages: their profiles are collected and broadcast, 300 numbers each.
MOST_LABELS = 2_000
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    if not _TABLE:
        codes = np.arange(0x110000, dtype=np.int64)
        is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _TABLE.append(np.where(is_letter, codes, 32))
    return _TABLE[0]


def grams(text: str, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as numbers (21 bits a letter) with their counts, most frequent first;
    ties by number.  Lone blanks are none."""
    codes = _letters()[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    codes = codes[keep]
    blank = codes == 32
    parts = []
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        value = codes[: len(codes) - n + 1].copy()
        for k in range(1, n):
            value <<= 21
            value |= codes[k : len(codes) - n + 1 + k]
        inside = np.ones(len(value), bool) if n < 3 else ~blank[1 : len(codes) - n + 2]
        if n == 1:
            inside = ~blank
        for k in range(2, n - 1):
            inside &= ~blank[k : len(codes) - n + 1 + k]
        parts.append(value[inside])
    every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    if not len(every):
        return every, every
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.diff(np.append(first, len(every)))
    return every[first], counts


def top(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent values in order; values must be ascending."""
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        values, counts = values[near], counts[near]
    return values[np.argsort(-counts, kind="stable")[:size]]


def crc32_id(col: str) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def learn(
    docs: DataFrame, size: int = 300, longest: int = 3, sample: int = 500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang"
) -> dict[str, np.ndarray]:
    """Profiles by language, from at most ``sample`` texts of each; at most ``MOST_LABELS`` languages (checked)."""
    label, text = F.col(label_col).cast("string"), F.col(text_col).cast("string")
    told = docs.select(F.xxhash64(F.col(id_col), label, text).alias("_key"), label.alias("label"), text.alias("text")).filter("label is not null and text is not null")
    # the least hashes of each language in two steps, so that no task sees more than ``sample`` for each share
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_key"))
    few = told.select("label", "_key", F.pmod("_key", F.lit(64)).alias("_share")).dropDuplicates(["label", "_key"])
    few = few.withColumn("_nth", nth("label", "_share")).filter(F.col("_nth") <= sample)
    chosen = written(few.withColumn("_nth", nth("label")).filter(F.col("_nth") <= sample).select("label", "_key"), "chosen")
    n, labels = chosen.agg(F.count("*"), F.countDistinct("label")).first()
    if labels > MOST_LABELS:
        raise ValueError(f"{labels} labels are more than a table of profiles takes ({MOST_LABELS})")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "text"):
            for label, text in zip(batch.column(0).to_pylist(), texts):
                values, counts = grams(text or "", longest)
                if len(values):
                    yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(values)), "gram": pa.array(values), "n": pa.array(counts.astype(np.int64))})

    texts = told.join(F.broadcast(chosen) if n <= FEW else chosen, ["label", "_key"], "left_semi").dropDuplicates(["label", "_key"]).select("label", "text")
    totals = texts.mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    rows = totals.withColumn("r", rank).filter(F.col("r") <= size).collect()  # languages x size rows
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["r"])):
        found.setdefault(r["label"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in sorted(found.items())}


class Profiles:
    """Out-of-place distances to all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int, longest: int):
        self.names, self.size, self.longest = sorted(profiles), size, longest
        self.known = np.unique(np.concatenate([profiles[k] for k in self.names])) if profiles else np.zeros(0, np.int64)
        self.place = np.full((len(self.names), len(self.known) + 1), -1, np.int64)
        for i, k in enumerate(self.names):
            self.place[i, np.searchsorted(self.known, profiles[k])] = np.arange(len(profiles[k]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        values, counts = grams(text or "", self.longest)
        if not len(values) or not len(self.names):
            return UNDETERMINED, 0.0
        own = top(values, counts, self.size)
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        place = self.place[:, at]
        apart = np.where(place < 0, self.size, np.abs(place - np.arange(len(own)))).sum(1)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / (self.size * len(own))


def identify(
    docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 300, longest: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The ``keep`` columns with lang_pred and score (or what ``names`` calls them), for the whole text of each row."""
    keep = tuple(c for c in keep if c not in names)
    kept = docs.select(*keep).schema
    # a kept text of strings is sent to Python once
    twice = text_col not in keep or dict(docs.dtypes)[text_col] != "string"
    sent = "_v_text" if twice else text_col
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size, longest))

    def predict(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = shared.value.nearest
        for batch, texts in batches(source, sent):
            found, scores = zip(*map(nearest, texts))
            own = batch.num_columns - twice
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:own], *names])

    out = kept.add(names[0], "string").add(names[1], "double")
    return docs.select(*keep, *([F.col(text_col).cast("string").alias("_v_text")] if twice else [])).mapInArrow(predict, out)


def teaches(id_col: str = "doc_id") -> Column:
    """Whether a document may teach: crc32 of its id, modulo 4, isn't 2."""
    return F.coalesce(crc32_id(id_col) % 4 != 2, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_language_id``: the language of each document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.filter(teaches())))
    return found.select("doc_id", (~teaches()).alias("held_out"), "lang_pred", "score")
