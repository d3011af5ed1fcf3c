"""Models as arguments: embeddings of distinct texts, and replies of a language model put together again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sedge.operators.paragraphs import LEAST, PLACEHOLDER
from sedge.workspace import Scratch, join_hot

#: Texts that a model is given at once (fixed value).
BATCH = 25
#: What marks a place for a reader (fixed value).
OCR_MARK = "[⚠️ OCR_ERROR: 需人工核对]"
#: A text that more than one row in so many holds is joined back by broadcast; there are fewer than this.
HOT = 1000


def embed_texts(table: DataFrame, text: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = BATCH) -> DataFrame:
    """The rows with `embedding`, an array of floats; null texts have none.

    load makes a model, once in every worker; the model gets texts, at most `batch` at once, and gives as many vectors. Each
    distinct text is embedded once, however many rows hold it; the vectors are written before they are joined back, so
    a lost executor does not cost the model's work again.
    """

    def start() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def some(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(model(texts), dtype=np.float32)
            if len(out) != len(texts):
                raise ValueError(f"the model gave {len(out)} vectors for {len(texts)} texts")
            return out

        return some

    spark = table.sparkSession
    scratch = Scratch(spark, "embeddings")
    model = predict_batch_udf(start, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    # Rows without a text get keys of their own, which meet nothing.
    keyed = table.withColumn("_key", F.sha2(text, 256))
    known = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias("_t"), F.count(F.lit(1)).alias("_n"))
    known = scratch.keep(known, "texts")
    total = known.agg(F.sum("_n")).first()[0] or 0
    vectors = scratch.keep(known.select("_key", "_n", model("_t").alias("embedding")), "vectors")
    met = join_hot(keyed.where(F.col(text).isNotNull()), vectors, "_key", F.col("_n") > total / HOT).drop("_key", "_n")
    return met.select(*table.columns, "embedding").unionByName(table.where(F.col(text).isNull()).withColumn("embedding", F.lit(None).cast("array<float>")))


def strip_code_fence(reply: Column) -> Column:
    """A reply without the fence around it: one of the openings after another, then the end."""
    stripped = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    out = stripped(reply)
    for opening in ("```markdown", "```md", "```"):
        out = F.when(out.startswith(opening), stripped(F.substring(out, len(opening) + 1, 1 << 30))).otherwise(out)
    return F.when(out.endswith("```"), stripped(F.left(out, F.length(out) - 3))).otherwise(out)


def reviewed_segments(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, segment, text, changes, errors of every segment (doc_id, segment, text) after its reply (doc_id, segment, reply).

    A segment with a placeholder, and a short one, keeps its text whatever is replied; so does one whose reply is missing. A
    reply counts as one change; what it marks for a reader counts as errors. Of several replies the least is taken.
    """
    one = replies.groupBy("doc_id", "segment").agg(F.min("reply").alias("reply"))
    left_alone = F.contains("text", F.lit(PLACEHOLDER)) | (F.length("text") < LEAST)
    met = segments.join(one.hint("merge"), ["doc_id", "segment"], "left").withColumn("_c", F.when(~left_alone, strip_code_fence(F.col("reply"))))
    errors = F.when(F.col("_c").isNotNull(), (F.length("_c") - F.length(F.replace("_c", F.lit(OCR_MARK)))) / len(OCR_MARK)).otherwise(0)
    return met.select("doc_id", "segment", F.coalesce("_c", "text").alias("text"), F.col("_c").isNotNull().cast("long").alias("changes"), errors.cast("long").alias("errors"))


def reviewed_documents(reviewed: DataFrame) -> DataFrame:
    """doc_id, text (segments in order, a line feed between), segments, changes and errors. A document's text is one row, as it was."""
    text = F.expr("listagg(text, '\n') within group (order by segment)")
    return reviewed.groupBy("doc_id").agg(text.alias("text"), F.count(F.lit(1)).alias("segments"), F.sum("changes").alias("changes"), F.sum("errors").alias("errors"))


# Queries: lines as segments, with replies of every kind by document and place; a model that counts vowels.
def _lines(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("segment", "text"))
    marked = F.when((F.col("doc_id") + F.col("segment")) % 7 == 0, F.concat("text", F.lit(PLACEHOLDER + "1@@"))).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("segment").cast("long").alias("segment"), marked.alias("text"))


def _replied(s, d):
    rows, kind, x = _lines(s, d), (F.col("doc_id") + 3 * F.col("segment")) % 6, F.col("text")
    reply = F.when(kind == 1, F.concat(F.lit("```markdown\n"), x, F.lit("\n```"))).when(kind == 2, F.concat(F.lit(" ```md "), F.replace(x, F.lit("e"), F.lit("E")), F.lit("```"))).when(kind == 3, F.concat(F.lit("```"), x, F.lit(f" {OCR_MARK} ")))
    reply = reply.when(kind == 4, F.concat(x, F.lit(OCR_MARK + OCR_MARK))).when(kind == 5, "")
    return reviewed_segments(rows, rows.select("doc_id", "segment", reply.alias("reply")).where("reply is not null"))


def vowel_model() -> Callable[[np.ndarray], np.ndarray]:
    return lambda texts: np.array([[t.count(c) for c in "aeiou"] for t in texts], dtype=np.float32)


def _embedded(s, d):
    rows = embed_texts(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text", vowel_model)
    return rows.select("doc_id", *(F.get("embedding", F.lit(k)).cast("long").alias(c) for k, c in enumerate("aeiou")))


QUERIES = {
    "review_replies": lambda s, d: _replied(s, d).select("doc_id", "segment", "changes", "errors", F.md5("text").alias("md5")),
    "review_documents": lambda s, d: reviewed_documents(_replied(s, d)).select("doc_id", "segments", "changes", "errors", F.md5("text").alias("md5")),
    "embed_texts": _embedded,
}
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_REVIEWED = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment FROM documents),
m AS (SELECT doc_id, segment, CASE WHEN (doc_id + segment) % 7 = 0 THEN text || '{PLACEHOLDER}1@@' ELSE text END AS text FROM l),
r AS (SELECT *, CASE (doc_id + 3 * segment) % 6 WHEN 1 THEN {_STRIP.format("text")} WHEN 2 THEN {_STRIP.format("replace(text, 'e', 'E')")} WHEN 3 THEN {_STRIP.format("text || ' " + OCR_MARK + "'")} WHEN 4 THEN {_STRIP.format("text || '" + OCR_MARK + OCR_MARK + "'")} WHEN 5 THEN '' END AS cleaned,
             CASE (doc_id + 3 * segment) % 6 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS marks FROM m),
v AS (SELECT doc_id, segment, contains(text, '{PLACEHOLDER}') OR length(text) < {LEAST} OR cleaned IS NULL AS kept, CASE WHEN kept THEN text ELSE cleaned END AS text, CASE WHEN kept THEN 0 ELSE 1 END AS changes, CASE WHEN kept THEN 0 ELSE marks END AS errors FROM r)"""
ORACLES = {
    "review_replies": f"{_REVIEWED} SELECT doc_id, segment, changes, errors, md5(text) AS md5 FROM v",
    "review_documents": f"{_REVIEWED} SELECT doc_id, count(*) AS segments, CAST(sum(changes) AS BIGINT) AS changes, CAST(sum(errors) AS BIGINT) AS errors, md5(string_agg(text, chr(10) ORDER BY segment)) AS md5 FROM v GROUP BY doc_id",
    "embed_texts": "SELECT doc_id, " + ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS {c}" for c in "aeiou") + " FROM documents",
}
