"""Hybrid retrieval as one batch plan: BM25 over postings, exact vector distance, weighted reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sedge.functions.tokens import DUCK_PATTERN, tokenize
from sedge.functions.segment import dictionary_tokenizer
from sedge.workspace import Scratch, parts_for, small_batches, spread

#: Fixed values of the ranking.
K1, B, NEGATIVE_IDF = 1.5, 0.75, 0.25
CANDIDATES, FUSED, RRF_K, BM25_WEIGHT, VECTOR_WEIGHT = 20, 5, 60, 0.3, 0.7
#: Terms of queries that are sent to all tasks at once.
QUERY_TERMS = 1 << 18
Tokenizer = Callable[[Column], Column]
#: Queries and chunks that meet in one task where queries are too many to send to all.
QUERY_BLOCK, CHUNK_BLOCK = 1024, 16384


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, text, source, section, embedding of all documents; those without a vector take part in the keyword ranking only."""
    docs, vectors = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    section = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("part "), (F.col("doc_id") % 7).cast("string")))
    parts = parts_for(docs)
    docs, vectors = docs.repartition(parts, "doc_id"), vectors.repartition(parts, "vec_id")
    return docs.join(vectors.hint("merge"), docs.doc_id == vectors.vec_id, "left").select(F.col("doc_id").alias("chunk_id"), "text", "source", section.alias("section"), "embedding")


def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, embedding; queries without a vector are ranked by keywords only."""
    asked, vectors = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return asked.join(vectors.hint("merge"), asked.item_id == vectors.vec_id, "left").select(F.col("item_id").alias("query_id"), "text", "embedding")


def postings(chunks: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """term, chunk_id, tf; combined where the tokens lie before they are shuffled."""
    return chunks.select("chunk_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def sound(embedding: Column) -> Column:
    """Whether a vector is there and holds no null and no NaN."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def asking(asked: DataFrame) -> DataFrame:
    """Queries that are more than white space; others have no result."""
    return asked.where(F.regexp_replace("text", r"(?U)\s+", "") != "")


def weighted(df: DataFrame, n: int) -> DataFrame:
    """term, df, idf of n chunks; a negative idf becomes a share of the mean."""
    raw = df.withColumn("raw", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, NEGATIVE_IDF * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def idf_table(terms: DataFrame, n: int) -> DataFrame:
    """term, df, idf from postings."""
    return weighted(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n)


def posting_stats(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf, doc_len and avgdl of every posting; null texts have no postings and count with length 0."""
    cut = chunks.select("chunk_id", F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("t"))
    mean = cut.agg(F.avg(F.size("t")).alias("avgdl"))  # one row
    terms = cut.select("chunk_id", F.size("t").cast("long").alias("doc_len"), F.explode("t").alias("term"))
    return terms.groupBy("term", "chunk_id", "doc_len").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(mean))


def with_lengths(chunks: DataFrame, parts: int, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """term, chunk_id, dl, tf of every posting, dealt by chunk; dl is the number of tokens of the chunk."""
    # Texts move once; their postings are counted where they are cut.
    cut = chunks.select("chunk_id", "text").repartition(parts, "chunk_id").select("chunk_id", tokenizer(F.col("text")).alias("t"))
    terms = cut.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


class Keywords:
    """Postings in buckets by chunk, and the statistics of their terms.

    Queries meet the postings where these lie: the terms of a bounded number of queries are broadcast, a chunk's score
    is summed in its bucket, and only each task's k best of a query are shuffled. A term that most chunks hold is spread
    as the chunks are. More queries come in more passes.
    """

    def __init__(self, chunks: DataFrame, tokenizer: Tokenizer = tokenize):
        self.scratch, self.tokenizer = Scratch(chunks.sparkSession, "bm25"), tokenizer
        parts = parts_for(chunks)
        self.terms = self.scratch.keep_bucketed(with_lengths(chunks, parts, tokenizer), "chunk_id", "postings", parts)
        self.n = chunks.count()
        self.avgdl = (self.terms.agg(F.sum("tf")).first()[0] or 0) / max(self.n, 1)
        df = self.terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw = F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.stats = self.scratch.keep(df.withColumn("raw", raw), "stats")
        self.mean = self.stats.agg(F.avg("raw")).first()[0] or 0.0

    def wanted(self, asked: DataFrame) -> DataFrame:
        """query_id, term and what an occurrence of weight one gains."""
        cut = asked.select("query_id", F.explode(self.tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
        idf = F.when(F.col("raw") < 0, NEGATIVE_IDF * F.lit(self.mean)).otherwise(F.col("raw"))
        return cut.join(self.stats.hint("merge"), "term").select("query_id", "term", (F.col("qn") * idf).alias("gain"))

    def scores(self, wanted: DataFrame) -> DataFrame:
        """query_id, chunk_id, score of chunks that hold a wanted term; wanted is broadcast."""
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.avgdl or 1.0)))
        hits = self.terms.join(F.broadcast(wanted), "term")
        return hits.groupBy("chunk_id", "query_id").agg(F.sum(F.col("gain") * weight).alias("score"))

    def best(self, asked: DataFrame, k: int | None, most: int = QUERY_TERMS) -> DataFrame:
        """query_id, chunk_id, score of the k best matches of every query; None: of all matches."""
        wanted = self.scratch.keep(self.wanted(asked), "wanted")
        blocks = max(-(-wanted.count() // most), 1)
        order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "chunk_id"))
        parts = []
        for b in range(blocks):
            found = self.scores(wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
            parts.append(found if k is None else found.withColumn("r", order).where(F.col("r") <= k))
        return reduce(DataFrame.unionByName, parts).select("query_id", "chunk_id", "score")


def bm25_search(chunks: DataFrame, asked: DataFrame, k: int = CANDIDATES, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """query_id, rank, chunk_id, score of the best chunks of every query.

    All chunks are ranked: where fewer than k score above 0, chunks without a match follow by id with score 0. While no
    match scores below 0, the k smallest ids hold enough of them; else as many more ids are taken as a query has matches.
    """
    index, asked = Keywords(chunks, tokenizer), asking(asked)
    spare = k
    scored = index.scratch.keep(index.best(asked, k if index.mean >= 0 else None), "scored")
    if index.mean < 0:
        spare += scored.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    least = index.scratch.keep(chunks.select("chunk_id").orderBy("chunk_id").limit(spare), "least")
    fill = asked.select("query_id").join(F.broadcast(least) if index.mean >= 0 else least)
    ranked = scored.unionByName(fill.withColumn("score", F.lit(0.0)).select("query_id", "chunk_id", "score"))
    best = ranked.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score")).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def _nearest(asked: list[tuple[int, np.ndarray]], names: np.ndarray, vectors: pd.Series, k: int) -> pd.DataFrame:
    """query_id, chunk_id, distance of each query's k nearest of some chunks; vectors of other lengths are not compared."""
    found = []
    sizes = vectors.map(len)
    for size in sizes.unique():
        here = (sizes == size).to_numpy()
        x, ids = np.stack(vectors[here].to_numpy()).astype(np.float64), names[here]
        for query_id, v in asked:
            if len(v) == size:
                d = np.sqrt(((v - x) ** 2).sum(1))
                near = np.round(d, 9)
                some = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1]) if len(near) > k else np.arange(len(near))
                found += [(query_id, int(ids[j]), float(d[j])) for j in some[np.lexsort((ids[some], near[some]))][:k]]
    return pd.DataFrame(found, columns=["query_id", "chunk_id", "distance"]).astype({"query_id": "int64", "chunk_id": "int64", "distance": "float64"})


def vector_search(chunks: DataFrame, asked: DataFrame, k: int = CANDIDATES, query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """query_id, rank, chunk_id, distance (Euclidean) of the nearest chunks of every query; ties go to the smaller id.

    Up to `query_block` queries are broadcast and each task keeps the k nearest of its own chunks. More are dealt into blocks
    of about that many, chunks into blocks of about `chunk_block`, and each block of queries meets each block of chunks in a
    task. Vectors that are missing or hold nulls or NaN take no part, nor do blank queries. Query ids are unique.
    """
    spark, schema = chunks.sparkSession, "query_id long, chunk_id long, distance double"
    small_batches(spark, 4096)
    rows = asking(asked).where(sound(F.col("embedding"))).select("query_id", "embedding")
    held = chunks.where(sound(F.col("embedding"))).select("chunk_id", "embedding")
    few = rows.limit(query_block + 1).collect()
    if len(few) <= query_block:
        shared = spark.sparkContext.broadcast([(r[0], np.array(r[1], dtype=np.float64)) for r in few])

        def against_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield _nearest(shared.value, batch["chunk_id"].to_numpy(), batch["embedding"], k)

        found = held.mapInPandas(against_all, schema)
    else:
        n_q, n_c = -(-rows.count() // query_block), max(-(-held.count() // chunk_block), 1)
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.withColumn("qb", deal("query_id", n_q)).withColumn("cb", all_of(n_c)).groupBy("qb", "cb")
        right = held.withColumn("cb", deal("chunk_id", n_c)).withColumn("qb", all_of(n_q)).groupBy("qb", "cb")

        def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            pairs = [(i, np.asarray(v, dtype=np.float64)) for i, v in zip(q["query_id"], q["embedding"], strict=True)]
            return _nearest(pairs, c["chunk_id"].to_numpy(), c["embedding"], k)

        found = left.cogroup(right).applyInPandas(meet, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("distance", F.round("distance", 9)).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "distance")


def rrf_fusion(bm25: DataFrame, vector: DataFrame, k: int = FUSED) -> DataFrame:
    """query_id, rank, chunk_id, score, retrieval_method: weighted reciprocal ranks summed; ties keep BM25 order first."""
    both = bm25.select("query_id", "chunk_id", F.col("rank").alias("br"), F.lit(None).cast("int").alias("vr")).unionByName(
        vector.select("query_id", "chunk_id", F.lit(None).cast("int").alias("br"), F.col("rank").alias("vr"))
    )
    one = both.groupBy("query_id", "chunk_id").agg(F.max("br").alias("br"), F.max("vr").alias("vr"))
    score = F.round(F.coalesce(BM25_WEIGHT / (RRF_K + F.col("br")), F.lit(0.0)) + F.coalesce(VECTOR_WEIGHT / (RRF_K + F.col("vr")), F.lit(0.0)), 12)
    method = F.when(F.col("vr").isNull(), "bm25").when(F.col("br").isNull(), "vector").otherwise("hybrid")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.col("br").asc_nulls_last(), F.col("vr").asc_nulls_last()))
    return one.withColumn("score", score).withColumn("retrieval_method", method).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score", "retrieval_method")


def hybrid_search(chunks: DataFrame, asked: DataFrame, k: int = FUSED, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """Retrieval results of a batch of queries, with content, source and section ('' where a chunk has none)."""
    fused = rrf_fusion(bm25_search(chunks, asked, tokenizer=tokenizer), vector_search(chunks, asked), k)
    section = F.coalesce("section", F.lit("")) if "section" in chunks.columns else F.lit("")
    # Few results are left, so the texts stay where they lie: only those that are asked for move.
    results = chunks.select("chunk_id", F.col("text").alias("content"), "source", section.alias("section"))
    kept = Scratch(chunks.sparkSession, "hybrid").keep(fused, "fused")
    wanted = results.join(kept.select("chunk_id").distinct().hint("merge"), "chunk_id", "left_semi")
    return kept.join(wanted.hint("merge"), "chunk_id")


def _both(f):
    return lambda spark, sf_dir: f(corpus(spark, sf_dir), question_set(spark, sf_dir))


def _numerals(number: Column) -> Column:
    """The digits of a number as Han characters: text without spaces."""
    return F.translate(number.cast("string"), "0123456789", "零一二三四五六七八九")


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every document as Han text, cut by a dictionary of fewer than a thousand numbers that other columns count."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.groupBy(_numerals(F.col("n_chars") % 1000).alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    cut = dictionary_tokenizer(words)
    asked = docs.select("doc_id", F.concat(_numerals(F.col("doc_id") * 7919 + 100), _numerals(F.col("n_chars")), F.lit("。GB/T "), F.coalesce("text", F.lit(""))).alias("text"))
    terms = spread(asked).select("doc_id", cut(F.col("text")).alias("t"))
    han = F.filter("t", lambda x: x.rlike("^[零一二三四五六七八九]"))
    return terms.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(han, "/").alias("han"))


def _term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus(spark, sf_dir)
    return idf_table(postings(chunks), chunks.count()).withColumn("idf", F.round("idf", 9))


QUERIES = {
    "tokenize": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(tokenize(F.col("text"))).alias("pos", "term")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("term").alias("n_terms"), F.min("term").alias("first_term")),
    "tokenize_dictionary": _segmented,
    "term_stats": _term_stats,
    "term_postings": lambda s, d: posting_stats(corpus(s, d)).withColumn("avgdl", F.round("avgdl", 6)),
    "bm25_search": _both(bm25_search),
    "vector_search": _both(vector_search),
    "rrf_fusion": _both(lambda c, q: rrf_fusion(bm25_search(c, q), vector_search(c, q), CANDIDATES)),
    "topk_fused": _both(lambda c, q: rrf_fusion(bm25_search(c, q), vector_search(c, q), min(FUSED, 3))),
    "hybrid_search": _both(lambda c, q: hybrid_search(c, q).select("query_id", "rank", "chunk_id", "score", "retrieval_method", "source", "section", F.length("content").alias("content_chars"))),
}

_CORPUS = rf"""
corpus AS MATERIALIZED (SELECT doc_id AS chunk_id, text, source, CASE WHEN doc_id % 3 > 0 THEN 'part ' || doc_id % 7 ELSE '' END AS section, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
asked AS (SELECT item_id AS query_id, text, embedding FROM benchmark LEFT JOIN embeddings ON item_id = vec_id),
tok AS (SELECT chunk_id, unnest(regexp_extract_all(text, '{DUCK_PATTERN}')) AS term FROM corpus),
post AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY ALL),
dls AS MATERIALIZED (SELECT chunk_id, len(regexp_extract_all(text, '{DUCK_PATTERN}')) AS dl FROM corpus),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN {NEGATIVE_IDF} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = rf"""
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(regexp_extract_all(text, '{DUCK_PATTERN}')) AS term FROM asked) GROUP BY ALL),
hit AS (SELECT query_id, chunk_id, sum(qn * idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / (SELECT avg(dl) FROM dls)))) AS score
        FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dls USING (chunk_id) GROUP BY ALL),
allb AS (SELECT a.query_id, c.chunk_id, round(coalesce(h.score, 0), 6) AS score FROM asked a CROSS JOIN corpus c LEFT JOIN hit h ON h.query_id = a.query_id AND h.chunk_id = c.chunk_id),
bm AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM allb) WHERE rank <= {CANDIDATES})"""
_VEC = rf"""
vd AS (SELECT a.query_id, c.chunk_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS distance FROM asked a CROSS JOIN corpus c WHERE c.embedding IS NOT NULL AND a.embedding IS NOT NULL),
ve AS (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank, chunk_id, distance FROM vd) WHERE rank <= {CANDIDATES})"""
_RRF = rf"""
fu AS (SELECT query_id, chunk_id, bm.rank AS br, ve.rank AS vr FROM bm FULL OUTER JOIN ve USING (query_id, chunk_id)),
fs AS (SELECT *, round(coalesce({BM25_WEIGHT} / ({RRF_K} + br), 0) + coalesce({VECTOR_WEIGHT} / ({RRF_K} + vr), 0), 12) AS score,
       CASE WHEN vr IS NULL THEN 'bm25' WHEN br IS NULL THEN 'vector' ELSE 'hybrid' END AS retrieval_method FROM fu),
fr AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, br NULLS LAST, vr NULLS LAST) AS INT) AS rank, chunk_id, score, retrieval_method FROM fs)"""
_HAN = "translate({0}, '0123456789', '零一二三四五六七八九')"
_DICTIONARY = rf"""
WITH RECURSIVE raw AS (SELECT {_HAN.format("CAST(n_chars % 1000 AS VARCHAR)")} AS word, count(*) AS n FROM documents GROUP BY 1),
total AS MATERIALIZED (SELECT sum(n) AS n, CAST(floor(1000000 * ln(sum(n)) + 0.5) AS BIGINT) AS alone FROM raw),
words AS MATERIALIZED (SELECT word, CAST(floor(1000000 * ln(total.n / raw.n) + 0.5) AS BIGINT) AS cost FROM raw, total),
src AS MATERIALIZED (SELECT doc_id, {_HAN.format("(doc_id * 7919 + 100) || '' || n_chars")} AS han, coalesce(text, '') AS text FROM documents),
r AS (
    SELECT doc_id, han, length(han) + 1 AS i, [CAST(0 AS BIGINT)] AS costs, [''] AS paths FROM src
    UNION ALL
    SELECT doc_id, han, i, list_prepend(best.cost, costs[1:2]), list_prepend(best.word || best.rest, paths[1:2])
    FROM (SELECT r.doc_id, r.han, r.i - 1 AS i, costs, paths,
                 list_sort(list_filter([{{'cost': coalesce(a.cost, alone) + costs[1], 'short': -1, 'word': substr(han, r.i - 1, 1), 'rest': '/' || paths[1]}},
                                        CASE WHEN len(costs) > 1 THEN {{'cost': b.cost + costs[2], 'short': -2, 'word': substr(han, r.i - 1, 2), 'rest': '/' || paths[2]}} END,
                                        CASE WHEN len(costs) > 2 THEN {{'cost': c.cost + costs[3], 'short': -3, 'word': substr(han, r.i - 1, 3), 'rest': '/' || paths[3]}} END], lambda x: x.cost IS NOT NULL))[1] AS best
          FROM r CROSS JOIN total LEFT JOIN words a ON a.word = substr(han, r.i - 1, 1) LEFT JOIN words b ON b.word = substr(han, r.i - 1, 2) LEFT JOIN words c ON c.word = substr(han, r.i - 1, 3)
          WHERE r.i > 1))
SELECT r.doc_id, len(string_split(rtrim(paths[1], '/'), '/')) + 2 + len(regexp_extract_all(text, '{DUCK_PATTERN}')) AS n_tokens, rtrim(paths[1], '/') AS han FROM r JOIN src USING (doc_id) WHERE i = 1
"""

ORACLES = {
    "tokenize": rf"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{DUCK_PATTERN}')) AS term FROM documents) SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms, min(term) AS first_term FROM t GROUP BY doc_id",
    "tokenize_dictionary": _DICTIONARY,
    "term_stats": f"WITH {_CORPUS} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "term_postings": f"WITH {_CORPUS} SELECT term, chunk_id, CAST(dl AS BIGINT) AS doc_len, tf, round((SELECT avg(coalesce(dl, 0)) FROM dls), 6) AS avgdl FROM post JOIN dls USING (chunk_id)",
    "bm25_search": f"WITH {_CORPUS}, {_BM25} SELECT * FROM bm",
    "vector_search": f"WITH {_CORPUS}, {_VEC} SELECT * FROM ve",
    "rrf_fusion": f"WITH {_CORPUS}, {_BM25}, {_VEC}, {_RRF} SELECT * FROM fr WHERE rank <= {CANDIDATES}",
    "topk_fused": f"WITH {_CORPUS}, {_BM25}, {_VEC}, {_RRF} SELECT * FROM fr WHERE rank <= 3",
    "hybrid_search": f"WITH {_CORPUS}, {_BM25}, {_VEC}, {_RRF} SELECT fr.*, source, section, length(text) AS content_chars FROM fr JOIN corpus USING (chunk_id) WHERE rank <= {FUSED}",
}
