"""Text files, file inventories and chunk collections as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Extensions that are read, in the order of their loading (fixed values).
EXTENSIONS = ("md", "txt")


def scan_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, ext and text of every Markdown and text file directly in a folder; other files and empty ones are passed over."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{md,txt}").select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return found.select("file_name", F.regexp_extract("file_name", r"\.([^.]+)$", 1).alias("ext"), "text")


def scan_file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder; contents are not read. Empty files are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def sink_chunks(chunks: DataFrame, folder: str) -> None:
    """Append a chunk collection, one folder a source."""
    chunks.write.mode("append").partitionBy("source").parquet(folder)


def scan_content_list(spark: SparkSession, pattern: str) -> DataFrame:
    """file_name, n and img_path of the table blocks with an image in files that hold one JSON array each.

    n counts a file's blocks from 0. A file that is no array of objects gives no row.
    """
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value"))
    parsed = F.try_parse_json("value")
    blocks = files.withColumn("kind", F.schema_of_variant(parsed)).where("kind like 'ARRAY%'").select("file_name", F.posexplode(F.from_json("value", "array<struct<type:string,img_path:string>>")).alias("n", "b"))
    return blocks.where("b.type = 'table' and b.img_path <> ''").select("file_name", "n", F.col("b.img_path").alias("img_path"))
