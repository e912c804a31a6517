"""The data model: tables of a collation, with fixed schemas."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .config import Settings

_TYPES = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}


def _schema(columns: str) -> StructType:
    """Columns as "name type, ...": needs no session, unlike Spark's own parser."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


UNITS = _schema(
    "app_id string, book string, chapter int, verse int, verse_id string, app_from int, app_to int, app_type string, "
    "lemma_text string, lemma_wit string, n_readings int, polarity string"
)
READINGS = _schema(
    "app_id string, reading_id string, reading_type string, var_seq string, reading_text string, is_lemma boolean, n_wit_raw int"
)
ATTESTATION = _schema("app_id string, reading_id string, witness_raw string, base_ga string, hand string")
WITNESSES = _schema(
    "base_ga string, family string, family_source string, weight double, docid int, date_early int, date_late int, date_mid int"
)
TABLES = {"units": UNITS, "readings": READINGS, "attestation": ATTESTATION, "witness_metadata": WITNESSES}


@dataclass(frozen=True)
class Collation:
    """Units (spans of the base text), their readings, who attests them, and the witnesses."""

    units: DataFrame
    readings: DataFrame
    attestation: DataFrame
    witnesses: DataFrame | None = None
    settings: Settings = Settings()
    #: One reading of each witness in each unit by all policies (``choose.settled``), where it was written.
    chosen: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.units.sparkSession

    @cached_property
    def known(self) -> DataFrame:
        """(base_ga, family) of the witnesses, to be broadcast if they are few (counted once)."""
        return bounded(self.witnesses.select("base_ga", "family"))

    def with_witnesses(self, witnesses: DataFrame) -> Collation:
        return replace(self, witnesses=witnesses)

    def with_settings(self, **changes) -> Collation:
        return replace(self, settings=replace(self.settings, **changes), chosen=None)


def save(collation: Collation, folder: str) -> None:
    """Rebuild the store: one Parquet table each, overwritten."""
    for name in ("units", "readings", "attestation"):
        getattr(collation, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    if collation.witnesses is not None:
        collation.witnesses.write.mode("overwrite").parquet(f"{folder}/witness_metadata.parquet")


def load(spark: SparkSession, folder: str, settings: Settings | None = None, with_witnesses: bool = True) -> Collation:
    """A stored collation."""
    read = lambda name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")
    witnesses = read("witness_metadata") if with_witnesses else None
    return Collation(read("units"), read("readings"), read("attestation"), witnesses, settings or Settings())


def save_metric(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Overwrite a metric table and read it again (later stages build on the stored one)."""
    path = f"{folder}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once: write it in the folder of spark.checkpoint.dir and read it again, so that plans that
    use it several times stay small.  Where the session names no shared folder, ``df`` as it is."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/variorum/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a table of witnesses that is broadcast after it was counted (some 50 bytes each).
FEW = 500_000


def bounded(df: DataFrame, few: int = FEW) -> DataFrame:
    """``df`` to be broadcast if it has at most ``few`` rows, which are counted; beyond, as it is."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df
