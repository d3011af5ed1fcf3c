"""Streams: state that expires, late rows, statistics of an index that grows."""

import datetime

from pyspark.sql import functions as F

from sedge.operators import documents, retrieval
from sedge.streaming import keyed

DAY = datetime.datetime(2024, 1, 1)
SHAPE = "user_id long, task long, event_id long, ts timestamp_ntz, status string"


def fed(spark, tmp_path, make, batches):
    """Rows, and the state rows held at the end, of a stream that reads one batch after another."""
    (tmp_path / "in").mkdir()
    stream = make(spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = None
    for k, rows in enumerate(batches):
        given = [(u, u, e, DAY + datetime.timedelta(seconds=at), status) for u, e, at, status in rows]
        spark.createDataFrame(given, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
        assert query.exception() is None, k
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_requests_leave_no_state(spark, tmp_path):
    late = 5_000_000
    batches = [[(1, 1, 0, ""), (1, 2, 1, ""), (1, 3, 2, ""), (2, 4, 3, "")], [(2, 5, 100_000, ""), (1, 6, 90_000, "")], [(3, 7, 100_001, ""), (1, 8, 10, "")]]
    got, held = fed(spark, tmp_path, lambda r: keyed.rate_limit_stream(r, 2, 60, delay=late), batches)
    # Keys 1 and 2 are idle behind the watermark; row 8 comes from before it and has no verdict.
    assert {(r.event_id, r.accepted) for r in got.collect()} == {(1, True), (2, True), (3, False), (4, True), (5, True), (6, True), (7, True)}
    assert held <= 2


def test_jobs_are_forgotten(spark, tmp_path):
    hour = 3_600_000_000
    batches = [[(1, 1, 0, "pending"), (1, 3, 20, "completed"), (1, 2, 10, "processing"), (2, 4, 5, "cancelled")], [(1, 5, 15, "failed"), (3, 6, 60, "pending")], [(3, 7, 50_000, "processing")], [(2, 8, 50_001, "processing"), (1, 9, 30, "failed")]]
    got, held = fed(spark, tmp_path, lambda r: keyed.task_status_stream(r, delay=hour // 2, idle=hour), batches)
    rows = sorted((r.task, r.applied, r.status, r.completed_at) for r in got.collect())
    done = DAY + datetime.timedelta(seconds=20)
    # Event 5 is older than what is known; job 2 was forgotten when event 8 came, else it would stay cancelled; event 9 is late.
    assert rows == [(1, 3, "completed", done), (2, 1, "cancelled", None), (2, 1, "processing", None), (3, 1, "pending", None), (3, 2, "processing", None)]
    assert held == 2


def test_statistics_of_a_growing_index(spark, tmp_path):
    shape = "doc_id long, source string, text string"
    parts = [[(1, "a", "x y\n\ny z " * 60), (2, "a", "x")], [(3, "b", None), (4, "b", "y y q")], [(5, "c", "")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        docs = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        came = keyed.incremental_index(docs, f"{tmp_path}/index", f"{tmp_path}/progress")
        assert came == documents.chunk_documents(spark.createDataFrame(rows, shape)).count(), k
        assert keyed.incremental_index(docs, f"{tmp_path}/index", f"{tmp_path}/progress") == 0
    every = documents.chunk_documents(spark.createDataFrame([r for p in parts for r in p], shape)).select(keyed.chunk_id().alias("chunk_id"), "text")
    stats, chunks, mean = keyed.index_statistics(spark, f"{tmp_path}/index")
    terms = retrieval.postings(every)
    key = lambda f: sorted((r.term, r.df, round(r.idf, 9)) for r in f.collect())
    assert key(stats) == key(retrieval.idf_table(terms, every.count()))
    assert chunks == every.count() and abs(mean - terms.agg(F.sum("tf")).first()[0] / chunks) < 1e-9
