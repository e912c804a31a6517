"""A collation over a star schema of orders: parts are units, suppliers witnesses, regions families.

Any long table of (unit, reading, witness, hand) can be read as a collation; this one serves tests,
benchmarks and the registered queries, which run the library's own plans over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..schema import Collation


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collation(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> Collation:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    chapter = F.regexp_extract("p_brand", "([0-9]+)", 1)
    key = F.col("p_partkey")
    units = part.select(
        F.concat(F.lit("U"), key.cast("string")).alias("app_id"),
        F.lit("B09").alias("book"),
        chapter.cast("int").alias("chapter"),
        F.col("p_size").alias("verse"),
        F.concat(F.lit("B09K"), chapter, F.lit("V"), F.col("p_size").cast("string")).alias("verse_id"),
        (key % 20 * 2).cast("int").alias("app_from"),
        (key % 20 * 2 + key % 3 * 2).cast("int").alias("app_to"),
        F.when(key % 37 == 0, "lac").otherwise("main").alias("app_type"),
        F.col("p_name").alias("lemma_text"),
    )
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_linestatus")
    reading = F.when(F.col("l_linenumber") <= 3, "a").when(F.col("l_linenumber") == 4, "b").when(F.col("l_linenumber") == 5, "c").when(F.col("l_linenumber") == 6, "d").otherwise("z")
    attestation = line.select(
        F.concat(F.lit("U"), F.col("l_partkey").cast("string")).alias("app_id"),
        reading.alias("reading_id"),
        F.when(F.col("l_suppkey") == 0, "basetext").otherwise(F.col("l_suppkey").cast("string")).alias("base_ga"),
        F.when(F.col("l_linestatus") == "F", "firsthand").otherwise("corrector").alias("hand"),
    ).repartition("app_id").distinct()  # by unit once, which serves all joins and groups by unit
    # a reading exists where it is attested; its type and text follow from its id
    readings = line.select(F.concat(F.lit("U"), F.col("l_partkey").cast("string")).alias("app_id"), reading.alias("reading_id")).repartition("app_id").distinct()
    kind = F.when(F.col("reading_id") == "c", "om").when(F.col("reading_id") == "d", "subreading").when(F.col("reading_id") == "z", "lac")
    readings = readings.select("app_id", "reading_id", kind.alias("reading_type"), F.concat_ws("-", F.lit("reading"), "reading_id", "app_id").alias("reading_text"), (F.col("reading_id") == "a").alias("is_lemma"))
    supplier, nation, region = (read(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    named = supplier.filter((F.col("s_suppkey") != 0) & (F.col("s_suppkey") % 11 != 5)).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    witnesses = named.select(F.col("s_suppkey").cast("string").alias("base_ga"), F.col("r_name").alias("family"), (200 + F.col("s_suppkey") * 13 % 1300).cast("int").alias("date_mid"))
    return Collation(units, readings, attestation, witnesses, settings)


#: The same view for an SQL engine, as common table expressions.
VIEW_SQL = """
units AS (
  SELECT concat('U', p_partkey) AS app_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS chapter, p_size AS verse,
    concat('B09K', regexp_extract(p_brand, '([0-9]+)', 1), 'V', p_size) AS verse_id,
    CAST(p_partkey % 20 * 2 AS INT) AS app_from, CAST(p_partkey % 20 * 2 + p_partkey % 3 * 2 AS INT) AS app_to,
    CASE WHEN p_partkey % 37 = 0 THEN 'lac' ELSE 'main' END AS app_type, p_name AS lemma_text
  FROM part),
attestation AS (
  SELECT DISTINCT concat('U', l_partkey) AS app_id,
    CASE WHEN l_linenumber <= 3 THEN 'a' WHEN l_linenumber = 4 THEN 'b' WHEN l_linenumber = 5 THEN 'c' WHEN l_linenumber = 6 THEN 'd' ELSE 'z' END AS reading_id,
    CASE WHEN l_suppkey = 0 THEN 'basetext' ELSE CAST(l_suppkey AS VARCHAR) END AS base_ga,
    CASE WHEN l_linestatus = 'F' THEN 'firsthand' ELSE 'corrector' END AS hand
  FROM lineitem),
readings AS (
  SELECT DISTINCT app_id, reading_id, CASE reading_id WHEN 'c' THEN 'om' WHEN 'd' THEN 'subreading' WHEN 'z' THEN 'lac' END AS reading_type,
    concat('reading-', reading_id, '-', app_id) AS reading_text, reading_id = 'a' AS is_lemma
  FROM attestation),
witness_metadata AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS base_ga, r_name AS family, CAST(200 + s_suppkey * 13 % 1300 AS INT) AS date_mid
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_suppkey <> 0 AND s_suppkey % 11 <> 5)"""
