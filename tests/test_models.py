"""Embeddings of distinct texts, fences, and replies put together."""

import numpy as np
from pyspark.sql import functions as F

from sedge.operators import models


def test_each_text_is_seen_once(spark, tmp_path):
    def load():
        def model(texts):
            import uuid

            assert len(texts) <= 3
            (tmp_path / uuid.uuid4().hex).write_text("\n".join(texts))
            return np.array([[len(t), t.count("a")] for t in texts])

        return model

    rows = [(k, t, 1) for k, t in enumerate(["a", "bb", "a", None, "", "ccc", "bb", "a", "d", "e", None])]
    got = models.embed_texts(spark.createDataFrame(rows, "id int, text string, _t int"), "text", load, batch=3)
    assert got.columns == ["id", "text", "_t", "embedding"]
    assert {r.id: r.embedding for r in got.collect()} == {k: None if t is None else [len(t), t.count("a")] for k, t, _ in rows}
    seen = sorted(t for f in tmp_path.iterdir() for t in f.read_text().split("\n"))
    assert seen == ["", "a", "bb", "ccc", "d", "e"]


def test_fences(spark):
    given = {"```markdown\nx\n```": "x", " ```md x```  ": "x", "```x": "x", "x```": "x", "x": "x", "```markdown ```md y``` ```": "y```", "": "", " \n": "", "````": "`", "a\n```b```": "a\n```b", None: None}
    frame = spark.createDataFrame(list(given.items()), "reply string, want string")
    assert frame.where(~models.strip_code_fence(F.col("reply")).eqNullSafe(F.col("want"))).collect() == []


def test_replies_put_together(spark):
    long = "word " * 12
    segments = [(1, 0, long), (1, 1, "short"), (1, 2, long + "@@TABLE_PLACEHOLDER_0@@"), (1, 3, long + "b"), (1, 10, long + "c"), (2, 0, "")]
    replies = [(1, 0, f"```md\nA {models.OCR_MARK}\n```"), (1, 1, "changed"), (1, 2, "changed"), (1, 10, "C"), (1, 10, "D"), (3, 0, "x")]
    reviewed = models.reviewed_segments(spark.createDataFrame(segments, "doc_id long, segment long, text string"), spark.createDataFrame(replies, "doc_id long, segment long, reply string"))
    got = {r.doc_id: (r.text, r.segments, r.changes, r.errors) for r in models.reviewed_documents(reviewed).collect()}
    assert got == {1: ("\n".join([f"A {models.OCR_MARK}", "short", segments[2][2], segments[3][2], "C"]), 5, 2, 1), 2: ("", 1, 0, 0)}
