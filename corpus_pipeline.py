"""A training corpus from raw documents, in five stages of the operators in ``variorum.llm``.

Each stage takes all that its predecessor kept; what it decides takes effect.  All but the last
return the columns of ``documents``, and each result is written in the shared folder and read again.

Further columns pass all stages but the last, whatever their names: helper columns start with _v_.  An
empty table gives an empty result at each stage.  Null or wordless texts go in the first stage, a null
language is filled in there; a null source is the source ''.  Rows with a null id are documents like any
other: they pass line dedup unchanged, and of near duplicates among them one stays.  Rows with one id and
different texts are documents of their own, equal rows fall to one.  Very long texts pass whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import language, line_dedup, mixing, near_dedup, packing, tokens
from variorum.llm._frames import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no learned language (no letters, or null) go; a missing language is filled in."""
    profiles = language.learn(docs.filter(language.teaches()))
    found = language.identify(docs, profiles, keep=tuple(docs.columns), names=("_v_lang_pred", "_v_score"))
    kept = found.filter(F.col("_v_lang_pred") != language.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "_v_lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of several lines that stand in an earlier document go, and documents of which all goes."""
    found = line_dedup.dedup_lines(docs, counts=("_v_lines", "_v_removed"))
    left = found.filter((F.col("_v_removed") < F.col("_v_lines")) | (F.col("_v_removed") == 0))
    return left.withColumn("n_chars", F.when(F.col("_v_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id (nulls last) stays.

    Rows are told apart by id and text, so a repeated id costs no other text and copies without an id
    fall to one.  Texts without a word are classes of their own; only repeated rows of them go.
    """
    rows = near_dedup.rooted(docs).filter("root is not null")
    place = F.struct(F.col("_v_id").isNull().alias("none"), "_v_id", "tid")
    stay = rows.groupBy("root").agg(F.min(place).alias("p")).select(F.col("p._v_id").alias("_v_first"), F.col("p.tid").alias("_v_tid"))
    told = docs.withColumn("_v_own", near_dedup.digest())
    first = (F.col("_v_own") == F.col("_v_tid")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_v_first"))
    worded = told.join(stay, first, "left_semi")
    wordless = told.filter(~F.rlike(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")))
    return worded.unionByName(wordless).dropDuplicates(["doc_id", "_v_own"]).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose raw texts are near duplicates the one with the least id stays.

    Line dedup leaves loose lines of a copy, which near dedup can't know again; the raw texts tell.
    Rows with an id that stands for several classes of raw texts aren't decided by them.
    """
    key = lambda i, tid: F.coalesce(F.col(i).cast("long").cast("string"), F.hex(tid))
    raw = near_dedup.rooted(table(spark, sf_dir, "documents")).select(key("_v_id", "tid").alias("_v_key"), "root")
    raw = raw.groupBy("_v_key").agg(F.min("root").alias("_v_root"), F.max("root").alias("_v_high"), F.count_if(F.col("root").isNull()).alias("_v_none"))
    raw = raw.filter("_v_root = _v_high and _v_none = 0").select("_v_key", "_v_root")
    told = docs.withColumn("_v_key", key("doc_id", near_dedup.digest()))
    known = written(told.select("_v_key", F.col("doc_id").cast("long").alias("_v_id")).join(raw, "_v_key"), "raw-classes")
    place = F.struct(F.col("_v_id").isNull().alias("none"), "_v_id", "_v_key")
    least = known.groupBy("_v_root").agg(F.min(place).alias("_v_least"))
    gone = known.join(least, "_v_root").filter(place != F.col("_v_least")).select("_v_key").distinct()
    return told.join(gone, "_v_key", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn for the target mixture, one of each class of copies."""
    docs = written(one_of_each(spark, docs, sf_dir), "one-of-each")
    return mixing.calibrated(docs, capped=True).filter("_v_drawn").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokens.vocabulary_path(), 4096, packing.QUERY_END)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither rank-order profiles nor the vocabulary; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
