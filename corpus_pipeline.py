"""The cleaning pipeline over `documents`, one written table per stage.

Language, exact copies, near copies, personal data, packing: each stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sedge.llm import exact_dedup, language, packing, privacy, similar
from sedge.workspace import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts."""
    return language.accepted(docs, language.fit_language(docs, ~language.held_out())).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest, then the smallest id."""
    kept = exact_dedup.exact_groups(spark, docs).where("kept").select("doc_id")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similar shingle sets, the smallest id."""
    kept = similar.similar_documents(spark, docs).where("doc_id = component_id").select("doc_id")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal span replaced by its kind."""
    return privacy.redact_documents(docs, privacy.fit_privacy(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("exact dedup", keep_one_of_copies),
    ("near copies", keep_one_of_near_copies),
    ("personal data", redact_personal_data),
    ("packing", pack),
]

#: Trained models and tokenizers are no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again by the next, and then goes, but for the last."""
    scratch = Scratch(spark, "pipeline")
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:
            scratch.drop(written)
        written = docs
    return docs
