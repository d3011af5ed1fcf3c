"""Queries of the file sources: tables are written as files into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from sedge.sources import corpus
from sedge.workspace import Scratch

#: Rows of one written file: whole files are read as one text each.
ROWS = 500


def _folder(s: SparkSession, name: str) -> str:
    return f"{Scratch(s, name).root}/files"


def _texts(s, d, name):
    """The folder of the documents' texts, each with a line feed behind it."""
    folder = _folder(s, name)
    s.read.parquet(f"{d}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("value")).write.option("maxRecordsPerFile", ROWS).text(folder)
    return folder


def _corpus(s, d):
    found = corpus.scan_text_corpus(s, _texts(s, d, "texts"))
    line = F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1))
    return found.select("ext", line.alias("line")).groupBy("ext", F.md5("line").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


def _inventory(s, d):
    found = corpus.scan_file_inventory(s, _texts(s, d, "inventory"))
    return found.where(F.col("path").endswith(".txt")).agg(F.sum("length").alias("bytes"), (F.min("length") > 0).alias("none_empty"), F.count_if(F.col("modificationTime").isNull()).alias("undated"))


def _content_lists(s, d):
    """One array of blocks for every hundred suppliers, a file each; broken and other files lie among them."""
    folder = _folder(s, "blocks")
    k = F.col("s_suppkey")
    block = F.to_json(F.struct(F.when(k % 3 == 0, "text").otherwise("table").alias("type"), F.when(k % 5 != 0, F.concat(F.lit("images/"), k.cast("string"), F.lit(".png"))).otherwise("").alias("img_path"), F.col("s_name").alias("caption")))
    rows = s.read.parquet(f"{d}/supplier.parquet").groupBy(F.floor(k / 100).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), block.alias("b")))), lambda x: x["b"]), ", ").alias("b"))
    whole = rows.select(F.concat(F.lit("["), "b", F.lit("]")).alias("value"))
    broken = rows.select(F.concat(F.lit("["), "b").alias("value")).unionByName(rows.select(F.lit('{"type": "table", "img_path": "x.png"}').alias("value")))
    whole.unionByName(broken).write.option("maxRecordsPerFile", 1).text(folder)
    return corpus.scan_content_list(s, f"{folder}/*.txt").select("n", "img_path")


QUERIES = {"scan_text_corpus": _corpus, "scan_file_inventory": _inventory, "scan_content_list_json": _content_lists}

ORACLES = {
    "scan_text_corpus": "SELECT 'txt' AS ext, md5(line) AS md5, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY ALL",
    "scan_file_inventory": "SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, true AS none_empty, CAST(0 AS BIGINT) AS undated FROM documents",
    "scan_content_list_json": "SELECT n, 'images/' || k || '.png' AS img_path FROM (SELECT s_suppkey AS k, CAST(row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey) - 1 AS INT) AS n FROM supplier) WHERE k % 3 <> 0 AND k % 5 <> 0",
}
