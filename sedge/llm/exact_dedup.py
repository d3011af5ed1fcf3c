"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Two texts are equal when they are the same after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
A normalised text is cut where its own characters say so, so equal stretches give equal chunks wherever
they stand. Each distinct chunk moves once, to be compared with the others of the same fingerprint; it then
has a verified identifier (the place of its first occurrence). A document becomes the ordered list of its
chunk identifiers, and only those lists are compared: no whole text is moved.

Chunks and lists that more than a thousandth of all rows hold are fewer than a thousand: they are broadcast to
their rows, which would else meet in one task. What a list weighs times its rows is part of the table, so hot lists
together weigh less than a thousand lists of average size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.workspace import HOT_SHARE, Scratch, join_hot

#: A chunk ends after one of these letter pairs, between the two lengths; else at the greater length.
CUT_AFTER = "(?:qu|ux|tz|ck|wh|yo|gu|bl|nt|[.!?])"
SHORTEST, LONGEST = 768, 6144


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks_of(norm: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Content-defined chunks whose concatenation is the text; none for an empty text."""
    return F.regexp_extract_all(norm, F.lit(f"(?s).{{{shortest},{longest}}}?{CUT_AFTER}|.{{1,{longest}}}"), F.lit(0))


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and n_points.

    Of equal texts the one with the most code points in its original text stays, then the smallest id.
    Null counts as the empty text, and all empty texts are one group. Ids are integers, one for each text; rows without
    an id are left out, a repeated row counts again. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "exact-dedup")
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("original"))
    norm = normalised(F.col("original"))
    # The fingerprints of a document's chunks, in order; texts stay behind.
    recipes = scratch.keep(
        base.select("id", F.length(F.coalesce("original", F.lit(""))).cast("long").alias("n_points"), norm.alias("norm"))
        .select("id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks_of(F.col("norm")), lambda c: F.sha2(c, 256)).alias("prints")),
        "recipes",
    )
    # The chunk store: occurrences meet by fingerprint and are told apart by their text.
    store = (
        base.select("id", F.posexplode(chunks_of(norm)).alias("pos", "chunk"))
        .select(F.sha2("chunk", 256).alias("print"), "chunk", F.struct("id", "pos").alias("place"))
        .groupBy("print", "chunk")
        .agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
        .groupBy("print")
        .agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    )
    # A fingerprint with two texts would make its identifier wrong: the job stops rather than merge them.
    verified = F.when(F.col("texts") > 1, F.raise_error(F.lit("two chunks share a fingerprint")).cast("boolean")).otherwise(F.lit(True))
    store = scratch.keep(store.where(verified).select("print", F.col("place.id").alias("chunk_doc"), F.col("place.pos").alias("chunk_pos"), "n"), "store", sweep=True)
    chunks = store.agg(F.sum("n")).first()[0] or 0
    placed = (
        join_hot(recipes.select("id", F.posexplode("prints").alias("pos", "print")), store, "print", F.col("n") > chunks / HOT_SHARE)
        .groupBy("id")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "chunk_doc", "chunk_pos"))).alias("parts"))
        .select("id", F.transform("parts", lambda p: F.struct(p["chunk_doc"].alias("d"), p["chunk_pos"].alias("p"))).alias("recipe"))
    )
    lists = scratch.keep(
        recipes.select("id", "n_points", "text_sha256").join(placed.hint("merge"), "id", "left")
        .withColumn("recipe", F.coalesce("recipe", F.array().cast("array<struct<d:bigint,p:int>>"))),
        "lists",
    )
    scratch.drop(recipes, store)
    # Equal lists are equal texts. The hot list is summed where it lies before it is shuffled.
    groups = scratch.keep(
        lists.groupBy("recipe").agg(F.max(F.struct(F.col("n_points"), (-F.col("id")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("recipe", (-F.col("best.neg")).alias("keep_id"), "group_size"),
        "groups",
    )
    found = join_hot(lists, groups, "recipe", F.col("group_size") > lists.count() / HOT_SHARE)
    return scratch.answer(found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "text_sha256", "n_points"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(spark, docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS pts,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id)
"""
