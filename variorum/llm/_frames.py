"""Shared helpers: inputs, tables written to the cluster's shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, which must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Lost executors cost nothing that was written.  The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/variorum/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a table that is broadcast after it was counted (of some hundred bytes each at most).
FEW = 50_000
_SHARES = 512


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str | Column], few: int = FEW) -> DataFrame:
    """``rows`` with the columns of ``facts``, a written table of one row for each (non-null) key.

    Up to ``few`` facts are counted and broadcast.  Beyond, no task gets all rows of a key however common it
    is: a key's rows are dealt into shares by the hash of ``by``, the facts meet the distinct (key, share),
    of which a key has no more than there are shares, and the rows join these by key and share.
    """
    if facts.count() <= few:
        return rows.join(F.broadcast(facts), keys)
    return spread(rows, facts, keys, by)


def share(*by: str | Column) -> Column:
    """The share that a row belongs to, by the hash of ``by``."""
    return F.pmod(F.xxhash64(*by), F.lit(_SHARES)).cast("int")


def spread(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str | Column], how: str = "inner") -> DataFrame:
    """The second way of ``with_facts``, for facts of any size; ``how`` is inner or left."""
    dealt = rows.withColumn("_v_share", share(*by))
    met = dealt.select(*keys, "_v_share").distinct().join(facts, keys, how)
    return dealt.join(met, [*keys, "_v_share"]).drop("_v_share")


def batches(
    source: Iterator[pa.RecordBatch], text: str, limit: int = 4_000_000, rows: int = 4096
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of at most ``rows`` rows and about ``limit`` bytes of text (one longer text is a slice
    of its own), with the texts of each."""
    for batch in source:
        at, column = 0, batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        while at < len(sizes):
            stop, total = at, 0
            while stop < len(sizes) and stop - at < rows and (stop == at or total + sizes[stop] <= limit):
                total += sizes[stop]
                stop += 1
            part = batch.slice(at, stop - at)
            yield part, column.slice(at, stop - at).to_pylist()
            at = stop
    trim()


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # no such library on this platform: nothing to give back
        return None


_LIBC = _libc()


def out_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch of ``schema`` from lists or arrays by name."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in schema], schema=schema
    )


Batches = Iterator[pa.RecordBatch]
Mapper = Callable[[Batches], Batches]
