"""Keyed rules over streams; their batch twins are in sedge.operators.batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sedge.functions.tokens import DUCK_PATTERN
from sedge.operators import batches, documents, retrieval
from sedge.workspace import Scratch, parts_for


#: Microseconds: how far behind the newest event another may come, and how long a job without events is remembered.
DELAY, IDLE = 3_600_000_000, 30 * 86_400_000_000


def _timed(rows: DataFrame, key: str, delay: int, *more: str) -> DataFrame:
    """key, event_id, ts, us (microseconds) and more, with a watermark `delay` behind."""
    at = F.col("ts").cast("timestamp")
    return rows.select(key, "event_id", at.alias("ts"), F.unix_micros(at).alias("us"), *more).withWatermark("ts", f"{delay} microseconds")


def _in_order(frames: Iterator[pd.DataFrame], columns: list[str], least: int) -> Iterator[tuple]:
    """A key's rows of one micro-batch by time, then id, without those before `least`; a block at a time is cut to these columns."""
    blocks = [f.loc[f["us"] >= least, ["us", "event_id", *columns]] for f in frames]
    batch = pd.concat(blocks) if len(blocks) > 1 else blocks[0]
    return batch.sort_values(["us", "event_id"]).itertuples(index=False, name=None)


def _watermark(state: GroupState) -> int:
    """Microseconds; rows before it are late."""
    return state.getCurrentWatermarkMs() * 1000


def rate_limit_stream(requests: DataFrame, limit: int, seconds: int, key: str = "user_id", delay: int = DELAY) -> DataFrame:
    """Every request of a stream with whether it is accepted; a key's state is its last `limit` accepted times.

    Requests of one batch are taken in order of time, then id; one that comes in a later batch is judged as it comes, but a
    request from before the watermark (`delay` behind the newest time seen) is passed over, and has no row. Once the
    watermark is past a key's last accepted time by the window, none of its times counts any more: its state is removed.
    """
    span = seconds * 1_000_000

    def judge(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        verdicts = []
        for us, event in _in_order(frames, [], _watermark(state)):
            kept = [k for k in kept if us - k < span]
            verdicts.append((event, len(kept) < limit))
            if verdicts[-1][1]:
                kept.append(int(us))
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max((max(kept) + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [keys[0]] * len(verdicts), "event_id": [e for e, _ in verdicts], "accepted": [a for _, a in verdicts]}).astype({"event_id": "int64", "accepted": "bool"})

    rows = _timed(requests, key, delay)
    return rows.groupBy(key).applyInPandasWithState(judge, f"{key} long, event_id long, accepted boolean", "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def task_status_stream(events: DataFrame, key: str = "task", delay: int = DELAY, idle: int = IDLE) -> DataFrame:
    """The state of every job that a batch touches, after its events in order (time, id): status, completed_at, events applied.

    The state is three values and the time of the newest event: events of a later batch that are older than it are
    passed over, and so are events from before the watermark (`delay` behind the newest time seen). A job without events
    for `idle` microseconds behind the watermark is forgotten; an event that comes after that begins it anew.
    """

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, done, applied, seen = state.get if state.exists else (None, None, 0, None)
        before = applied
        for us, _, new in _in_order(frames, ["status"], _watermark(state)):
            if (seen is not None and us < seen) or (new == "processing" and status == "cancelled"):
                continue
            if new == "completed":
                done = int(us) if done is None else done
            elif new in ("pending", "processing"):
                done = None
            status, applied, seen = new, applied + 1, int(us)
        if applied > before:
            state.update((status, done, applied, seen))
            state.setTimeoutTimestamp(max((seen + idle) // 1000, state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame({key: [keys[0]], "status": [status], "us": pd.array([done], "Int64"), "applied": [applied]})
        elif state.exists:
            state.setTimeoutTimestamp(max((seen + idle) // 1000, state.getCurrentWatermarkMs()) + 1)

    rows = _timed(events, key, delay, "status")
    out = rows.groupBy(key).applyInPandasWithState(fold, f"{key} long, status string, us long, applied long", "status string, done long, applied long, seen long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, "status", F.timestamp_micros("us").cast("timestamp_ntz").alias("completed_at"), "applied")


def incremental_index(docs: DataFrame, folder: str, progress: str) -> int:
    """Chunks of the documents that have come since the last call, appended to a collection, with what they change in its
    statistics; returns how many chunks came.

    Each batch has folders of its own, for chunks, for the frequencies of its terms and for its sums, that a repeated batch
    writes anew: a lost driver leaves no row twice, and statistics need no pass over older chunks. Chunk ids are those of
    the document and the chunk.
    """
    spark, came = docs.sparkSession, []

    def append(batch: DataFrame, n: int) -> None:
        documents.chunk_documents(batch).write.mode("overwrite").parquet(f"{folder}/chunks/batch={n}")
        # What was written is read: later steps see the rows that stay.
        chunks = spark.read.parquet(f"{folder}/chunks/batch={n}").select(chunk_id().alias("chunk_id"), "text")
        terms = Scratch(spark, "terms").keep(retrieval.with_lengths(chunks, parts_for(chunks)), "terms")
        terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{folder}/frequencies/batch={n}")
        sums = chunks.agg(F.count(F.lit(1)).alias("chunks")).join(F.broadcast(terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))))
        sums.write.mode("overwrite").parquet(f"{folder}/sums/batch={n}")
        came.append(spark.read.parquet(f"{folder}/sums/batch={n}").agg(F.sum("chunks")).first()[0])

    docs.writeStream.foreachBatch(append).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return sum(came)


def chunk_id() -> Column:
    """The name of a chunk: its document's id and its own number."""
    return F.concat_ws("/", F.col("doc_id").cast("string"), F.coalesce("chunk_index", F.lit(0)).cast("string"))


def index_statistics(spark: SparkSession, folder: str) -> tuple[DataFrame, int, float]:
    """(term, df, idf) of a collection, its number of chunks and their mean length, folded from the batches' parts."""
    chunks, tokens = spark.read.parquet(f"{folder}/sums").agg(F.sum("chunks"), F.sum("tokens")).first()
    df = spark.read.parquet(f"{folder}/frequencies").groupBy("term").agg(F.sum("df").alias("df"))
    return retrieval.weighted(df, chunks), chunks, tokens / max(chunks, 1)


def drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What a stream holds now, written by a query that ends once it has caught up."""
    scratch = Scratch(spark, name)
    out = f"{scratch.root}/rows"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch.root}/progress").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file source takes folders or patterns.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def _status(s, d):
    events = _events(s, d).select(F.col("user_id").alias("task"), "ts", "event_id", batches.event_status().alias("status"))
    states = drained(task_status_stream(events), s, "task-status")
    # Every batch adds a row to a job that it touched; the last counts.
    return states.groupBy("task").agg(F.max_by(F.struct("status", "completed_at"), "applied").alias("s"), F.max("applied").alias("applied")).select("task", "s.*", "applied")


def _indexed(s, d, name):
    """Documents as a stream of one file each time, chunked and counted batch by batch: the folder."""
    given = s.read.parquet(f"{d}/documents.parquet").schema
    docs = s.readStream.schema(given).parquet(f"{d}/documents.parque[t]").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    root = Scratch(s, name).root
    incremental_index(docs, f"{root}/index", f"{root}/progress")
    return f"{root}/index"


def _index(s, d):
    return s.read.parquet(f"{_indexed(s, d, 'index')}/chunks").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def _index_terms(s, d):
    stats, chunks, mean = index_statistics(s, _indexed(s, d, "index-terms"))
    return stats.select("term", "df", F.round("idf", 9).alias("idf"), F.lit(chunks).cast("long").alias("chunks"), F.round(F.lit(mean), 6).alias("avgdl"))


QUERIES = {"rate_limit_stream": lambda s, d: drained(rate_limit_stream(_events(s, d), 3, 86400), s, "rate-limit"), "task_status_stream": _status, "incremental_index": _index, "incremental_statistics": _index_terms}
ORACLES = {
    "rate_limit_stream": batches.ORACLES["rate_limit"],
    "task_status_stream": batches.ORACLES["status_transition"],
    "incremental_statistics": rf"""
WITH RECURSIVE {documents._CHUNKS}, x AS MATERIALIZED (SELECT doc_id, chunk_index, text, regexp_extract_all(text, '{DUCK_PATTERN}') AS t FROM t WHERE text IS NOT NULL),
n AS MATERIALIZED (SELECT count(*) AS chunks, avg(len(t)) AS avgdl FROM x), u AS (SELECT DISTINCT doc_id, chunk_index, unnest(t) AS term FROM x), f AS (SELECT term, count(*) AS df FROM u GROUP BY term),
w AS MATERIALIZED (SELECT term, df, chunks, avgdl, ln((chunks - df + 0.5) / (df + 0.5)) AS raw FROM f, n), m AS MATERIALIZED (SELECT avg(raw) AS mean FROM w)
SELECT term, df, round(CASE WHEN raw < 0 THEN {retrieval.NEGATIVE_IDF} * mean ELSE raw END, 9) AS idf, chunks, round(avgdl, 6) AS avgdl FROM w, m""",
    "incremental_index": f"WITH RECURSIVE {documents._CHUNKS} SELECT doc_id, count(*) AS n FROM t WHERE text IS NOT NULL GROUP BY doc_id",
}
