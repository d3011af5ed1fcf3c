"""Record operators and sources on small inputs: malformed files, missing partners, surplus on either side."""

from pyspark.sql import functions as F

from sedge.operators import records as R, reports
from sedge.sources.corpus import scan_content_list


def test_content_lists(spark, tmp_path):
    (tmp_path / "a_content_list.json").write_text('[{"type": "text"},\n {"type": "table", "img_path": "i/1.png"}, {"type": "table", "img_path": ""}]')
    (tmp_path / "b_content_list.json").write_text('{"type": "table", "img_path": "no.png"}')
    (tmp_path / "c_content_list.json").write_text("[broken")
    found = [tuple(r) for r in scan_content_list(spark, f"{tmp_path}/*_content_list.json").collect()]
    assert found == [("a_content_list.json", 1, "i/1.png")]


def test_images_beside_tables(spark):
    rows = spark.createDataFrame([("<table>a<TABLE >b", ["1"]), ("no table", ["1"]), ("<table>", [])], "t string, i array<string>")
    got = [r[0] for r in rows.select(R.attach_table_images(F.col("t"), F.col("i"))).collect()]
    assert got == ["![表格图片](1)\n\n<table>a<TABLE >b", "no table", "<table>"]


def test_hits_of_repeated_and_missing_texts(spark):
    chunks = spark.createDataFrame([(0, "a", "s", 0), (1, "a", "s", 1), (2, "b", None, 2), (3, None, "s", None)], "idx long, text string, source string, chunk_index long")
    hits = spark.createDataFrame([(10, "a", "x", None), (11, "?", "s", 0), (12, "?", None, 2), (13, "?", "s", None), (14, None, None, None)], "hit long, text string, source string, chunk_index long")
    assert sorted(tuple(r) for r in R.vector_hit_to_chunk(hits, chunks).collect()) == [(10, 1), (11, 0), (12, 2)]


def test_restoring_nothing(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    kept = spark.createDataFrame([], "doc_id long, n int, placeholder string, table_html string")
    assert [tuple(r) for r in R.restore_tables(docs, kept).orderBy("doc_id").collect()] == [(1, "x", 0, 0), (2, None, 0, 0)]


def test_every_session_keeps_its_messages(spark):
    messages = spark.range(600).selectExpr("id div 3 as conv_id", "id % 3 as turn", "'user' as role")
    assert reports.session_messages(messages).count() == 600
    limited = reports.session_messages(messages, limit=2)
    assert limited.count() == 400 and limited.where("turn > 1").count() == 0


def test_deleted_sessions(spark):
    sessions = spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 7)], "conv_id long, task long")
    messages = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (9, "d"), (None, "e")], "conv_id long, task string")
    left, said = reports.delete_sessions(sessions, messages, spark.createDataFrame([(7,), (7,), (None,)], "task long"), "task")
    assert sorted(r.conv_id for r in left.collect()) == [2, 3] and sorted(r.task for r in said.collect()) == ["b", "b", "c", "d", "e"]
    left, said = reports.delete_sessions(sessions, messages, sessions.where("conv_id = 2"), "conv_id")
    assert left.count() == 3 and sorted(r.task for r in said.collect()) == ["a", "c", "d", "e"]
