"""The smaller sources: date lists, lemmatised texts, JSON dictionaries, NEXUS matrices, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of text files, numbered in each file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))


def read_dates(spark: SparkSession, path: str, docid: str = "manuscripts.manuscript.docID", orig: str = "manuscripts.manuscript.orig") -> DataFrame:
    """(docid, orig) of a CSV list; ids like 30001.0 count, others are skipped, the last row of an id wins."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    number = F.col(f"`{docid}`").try_cast("double")
    rows = rows.select(F.when(number.between(-2147483648.0, 2147483647.0), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))).cast("int").alias("docid"), F.coalesce(F.col(f"`{orig}`"), F.lit("")).alias("orig"), F.monotonically_increasing_id().alias("_n"))
    last = F.row_number().over(Window.partitionBy("docid").orderBy(F.desc("_n")))
    return rows.filter(F.col("docid").isNotNull()).withColumn("_last", last).filter("_last = 1").select("docid", "orig")


def read_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """(line, chapter, verse, pos, lemma) of white-space separated lines of seven fields or more."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).withColumn("f", f).filter(F.size("f") >= 7)
    code = F.get("f", F.lit(0))
    return rows.select("line", F.substring(code, 3, 2).cast("int").alias("chapter"), F.substring(code, 5, 2).cast("int").alias("verse"), F.get("f", F.lit(1)).alias("pos"), F.get("f", F.lit(6)).alias("lemma"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(ga, url_template) of a JSON link index; no rows without a file."""
    schema = "source string, index string, url_template string, note string, available array<string>"
    if not exists(spark, path):
        return spark.createDataFrame([], "ga string, url_template string")
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("available").alias("ga"), "url_template")


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    """(verse_id, english) of a JSON file {"verses": {id: text}}; no rows without a file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "verse_id string, english string")
    rows = spark.read.schema("verses map<string, string>").json(path, multiLine=True)
    return rows.select(F.explode("verses").alias("verse_id", "english"))


def bundle_siglum(name: str | Column) -> Column:
    """The siglum in a file name like 04_<siglum>[S1].xml; null if there is none."""
    c = F.col(name) if isinstance(name, str) else name
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"^04_", ""), r"\.xml$", ""), r"S\d*$", "")
    return F.when(F.rlike(s, F.lit(r"^(0\d+|\d+|P\d+|L\d+)$")), s)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(base_ga,): sigla of a folder's XML files, by their names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path).select("path")
    return files.select(bundle_siglum("path").alias("base_ga")).filter(F.col("base_ga").isNotNull()).distinct()


def read_nexus_characters(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, base_ga, reading_id): a character matrix as a long reading matrix; missing cells have no row."""
    rows = _lines(spark, path).withColumn("f", F.split(F.trim("value"), r"\s+"))
    block = rows.filter(F.rlike("value", F.lit(r"^\s+\S+\s+[0-9A-Za-z?]+\s*$")) & (F.size("f") == 2) & ~F.upper(F.get("f", F.lit(0))).isin("DIMENSIONS", "MATRIX", "FORMAT"))
    cells = block.select(F.get("f", F.lit(0)).alias("base_ga"), F.posexplode(F.split(F.get("f", F.lit(1)), "")).alias("k", "reading_id"))
    return cells.filter(~F.col("reading_id").isin("?", "-", "")).select(F.format_string("u%05d", "k").alias("app_id"), "base_ga", "reading_id")


def read_nexus_distances(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, distance), w1 < w2, of a full labelled distance matrix."""
    rows = _lines(spark, path).withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.rlike("value", F.lit(r"^\s+\S+(\s+\d+\.\d+){2,}\s*$")))
    order = Window.orderBy("line")  # one row a witness
    named = rows.withColumn("i", F.row_number().over(order) - 1).select("i", F.get("f", F.lit(0)).alias("w"), F.slice("f", F.lit(2), F.size("f")).alias("d"))
    long = named.select(F.col("w").alias("w1"), F.posexplode("d").alias("j", "distance"))
    met = long.join(named.select(F.col("i").alias("j"), F.col("w").alias("w2")), "j")
    return met.filter(F.col("w1") < F.col("w2")).select("w1", "w2", F.col("distance").cast("double").alias("distance"))
