"""Exact top-k inner products by columnar branch and bound.

Candidates are laid out in blocks, one column a dimension. A few queries at a time add their scores up over a few
dimensions at a time; what the dimensions to come can still add is at most the product of the two vectors'
remaining masses (norms). A candidate whose best possible score is under the query's floor, a score that k
candidates are known to reach, is dropped for it, and the columns are compacted to what any of these few queries
still needs. Floors come from a first pass, in which each query meets some blocks, and rise with every block a task
searches; queries that point the same way are searched together, so that they need the same columns.

All numbers are integers under 2**53, so sums in doubles are exact; bounds are rounded up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from sedge.workspace import Scratch

K, QUERY_BLOCK, CANDIDATE_BLOCK, DIMENSIONS_AT_ONCE, QUERIES_AT_ONCE = 5, 256, 2048, 8, 8
#: Candidate blocks that each query block meets to learn its floors.
SEEDS = 2


def _tail(squares: np.ndarray) -> np.ndarray:
    """Norms of what follows each dimension (rows), the whole vector's first, 0 last."""
    return np.vstack([np.sqrt(np.cumsum(squares[::-1], 0)[::-1]), np.zeros((1, squares.shape[1]))])


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None, step: int = DIMENSIONS_AT_ONCE,
    group: int = QUERIES_AT_ONCE, spent: list[int] | None = None,
) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in the block, but for those under its floor; ties to the smaller id;
    a query is no candidate of its own.

    queries: rows x dimensions; block: dimensions x candidates, integers in doubles. floors: a score of each query that k
    candidates reach somewhere; they are raised in place. spent: gets [products formed, products of a full scan].
    """
    if floors is None:
        floors = np.full(len(queries), -np.inf)
    # Dimensions with the most mass first: bounds close sooner. Queries by their strongest dimensions: like ones share columns.
    order = np.argsort(-(np.abs(block).sum(1) + np.abs(queries).sum(0)), kind="stable")
    block, turned = block[order], queries[:, order]
    mass = _tail(block**2)
    found: list[tuple[int, int, int]] = []
    by_sign = np.lexsort((turned[:, :6] > 0).T[::-1]) if turned.shape[1] else np.arange(len(turned))
    for at in range(0, len(by_sign), group):
        few = by_sign[at : at + group]
        found += _search_few(turned[few], query_ids[few], block, mass, ids, k, floors, few, step, spent)
    return found


def _search_few(queries, query_ids, block, mass, ids, k, floors, places, step, spent) -> list[tuple[int, int, int]]:
    dims = block.shape[0]
    query_mass = _tail(queries.T**2)
    score = np.zeros((len(queries), len(ids)))
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    if spent is not None:
        spent[1] += dims * score.size
    columns = np.arange(len(ids))
    for at in range(0, dims, step):
        end = min(at + step, dims)
        part = block[at:end] if len(columns) == len(ids) else block[at:end, columns]
        score += queries[:, at:end] @ part
        if spent is not None:
            spent[0] += part.size * len(queries)
        if end < dims and len(columns):
            rest = np.ceil(query_mass[end][:, None] * mass[end][None, columns] * (1 + 1e-12)) + 1
            if score.shape[1] > k:
                certain = np.partition(score - rest, -k, axis=1)[:, -k]
                np.maximum(floors[places], certain, out=certain)
                floors[places] = certain
            score[score + rest < floors[places][:, None]] = -np.inf
            alive = np.isfinite(score).any(0)
            if alive.mean() < 0.9:
                columns, score = columns[alive], score[:, alive]
    found = []
    for q, place in enumerate(places):
        keep = np.flatnonzero(np.isfinite(score[q]) & (score[q] >= floors[place]))
        keep = keep[np.lexsort((ids[columns[keep]], -score[q, keep]))][:k]
        if len(keep) == k:
            floors[place] = max(floors[place], score[q, keep[-1]])
        found += [(int(query_ids[q]), int(ids[columns[c]]), int(score[q, c])) for c in keep]
    return found


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): each component as floor(scale * x). Null vectors, and those with null or non-finite parts, are left out."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
    return table.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda a: F.floor(a.cast("double") * scale).cast("double")).alias("v"))


def blocks(vectors: DataFrame, size: int, n: int) -> DataFrame:
    """(block, dims, ids, cells): vectors by id hash into blocks of about `size`, stored column after column."""
    count = max(1, -(-n // size))

    def lay_out(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, part in pdf.groupby(pdf["v"].map(len)):
            for at in range(0, len(part), 2 * size):
                some = part.iloc[at : at + 2 * size]
                cells = np.stack(some["v"].to_numpy()).T if dims else np.zeros((0, len(some)))
                out.append((int(pdf["block"].iloc[0]), int(dims), some["id"].to_numpy(np.int64).tobytes(), np.ascontiguousarray(cells, dtype=np.float64).tobytes()))
        return pd.DataFrame(out, columns=["block", "dims", "ids", "cells"])

    return (
        vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
        .groupBy("block").applyInPandas(lay_out, "block int, dims int, ids binary, cells binary")
    )


PAIR = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def top_k(spark: SparkSession, table: DataFrame, is_query, k: int = K, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query row, all other rows being candidates.

    Fewer candidates than k give fewer rows; vectors of different lengths are not compared. Ids are unique; with
    repeated ids every copy counts and a query meets no copy of its own id. Other columns are ignored.
    """
    scratch = Scratch(spark, "top-k")
    # Arrow holds a group whole: a block has a bounded number of rows by its id hash, whatever the vectors are.
    vectors = scratch.keep(whole_vectors(table, id_col, vector_col, scale), "vectors")
    n = vectors.count()
    asked = vectors.where(is_query(F.col("id")))
    candidates = scratch.keep(blocks(vectors, CANDIDATE_BLOCK, n), "candidates")
    asking = scratch.keep(blocks(asked, QUERY_BLOCK, asked.count()), "queries").select(F.col("block").alias("q_block"), "dims", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    # The stated query set against all rows, block by block: each candidate block goes to the task of every query block.
    n_blocks = max(1, -(-n // CANDIDATE_BLOCK))
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, floors = None, None  # of the query block searched last: rows of one block often follow each other
        for batch in batches:
            rows: list[tuple] = []
            for q_block, dims, ids, cells, q_ids, q_cells, known in zip(*(batch[c] for c in ("q_block", "dims", "ids", "cells", "q_ids", "q_cells", "floors")), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                if last != (q_block, dims, len(q_ids), int(q_ids[0])):
                    last, floors = (q_block, dims, len(q_ids), int(q_ids[0])), np.frombuffer(known).copy() if known is not None else np.full(len(q_ids), -np.inf)
                rows += best_of_block(np.frombuffer(q_cells).reshape(dims, len(q_ids)).T, q_ids, np.frombuffer(cells).reshape(dims, len(ids)), ids, k, floors)
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for dims, ids, cells, q_ids, q_cells in zip(*(batch[c] for c in ("dims", "ids", "cells", "q_ids", "q_cells")), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                floors = np.full(len(q_ids), -np.inf)
                best_of_block(np.frombuffer(q_cells).reshape(dims, len(q_ids)).T, q_ids, np.frombuffer(cells).reshape(dims, len(ids)), ids, k, floors)
                out.append(floors.tobytes())
            yield pd.DataFrame({"q_block": batch["q_block"], "dims": batch["dims"], "q_ids": batch["q_ids"], "floors": out})

    def highest(pdf: pd.DataFrame) -> pd.DataFrame:
        floors = np.max([np.frombuffer(f) for f in pdf["floors"]], axis=0)
        return pd.DataFrame({"q_block": pdf["q_block"].iloc[:1], "q_ids": pdf["q_ids"].iloc[:1], "floors": [floors.tobytes()]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a pair of blocks, about 1 MB
    seeds = F.sequence(F.col("q_block"), F.col("q_block") + F.lit(min(SEEDS, n_blocks) - 1))
    few = asking.withColumn("block", F.explode(F.transform(seeds, lambda b: F.pmod(b, F.lit(n_blocks)).cast("int"))))
    seen = candidates.join(few.hint("shuffle_hash"), ["block", "dims"]).select("q_block", "dims", "ids", "cells", "q_ids", "q_cells")
    known = seen.mapInPandas(learn, "q_block int, dims int, q_ids binary, floors binary").groupBy("q_block", "dims", F.md5("q_ids").alias("h")).applyInPandas(highest, "q_block int, q_ids binary, floors binary")
    known = scratch.keep(known, "floors")  # at most SEEDS rows a query block
    asking = scratch.keep(asking.join(known.hint("merge"), ["q_block", "q_ids"], "left"), "asking")
    spread = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = candidates.join(spread.hint("shuffle_hash"), ["block", "dims"])
    best = scratch.keep(met.select("q_block", "dims", "ids", "cells", "q_ids", "q_cells", "floors").mapInPandas(search, PAIR), "best")
    # A task keeps k rows a query before they move.
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return scratch.answer(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
