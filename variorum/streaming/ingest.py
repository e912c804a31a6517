"""Incremental ingest: apparatus files that arrive in a folder are parsed once each into the store.

All metrics are batch plans over the stored tables; only the scan gains from streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as X
from ..schema import UNITS
from ..sources.tei import _NESTED, _entries


def ingest_new(spark: SparkSession, folder: str, store: str, checkpoint: str, settings: Settings = Settings(), name: str = "*.xml") -> None:
    """Append the entries of files that weren't seen before, then stop (a file's entries arrive whole)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", name).load(folder).select("content")

    def append(batch: DataFrame, epoch: int) -> None:
        entries = batch.mapInPandas(_entries, _NESTED).persist()
        place = X.parse_verse_id("verse_id")
        units = entries.select("*", place.alias("_p")).select("app_id", F.col("_p.book").alias("book"), F.col("_p.chapter").alias("chapter"), F.col("_p.verse").alias("verse"), "verse_id", "app_from", "app_to", "app_type", "lemma_text", "lemma_wit", "n_readings", F.lit(settings.polarity).alias("polarity"))
        each = entries.select("app_id", F.explode("readings").alias("r")).select("app_id", "r.*")
        seen = each.select("app_id", "reading_id", F.explode("wit").alias("witness_raw"))
        parts = {
            "units": units.select(*UNITS.names),
            "readings": each.select("app_id", "reading_id", "reading_type", "var_seq", "reading_text", "is_lemma", F.size("wit").alias("n_wit_raw")),
            "attestation": seen.select("*", X.siglum_base("witness_raw").alias("base_ga"), X.siglum_hand("witness_raw").alias("hand")),
        }
        for table, df in parts.items():
            # a retried epoch replaces what its first attempt wrote
            df.write.mode("overwrite").parquet(f"{store}/{table}.parquet/epoch={epoch}")
        entries.unpersist()

    files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
