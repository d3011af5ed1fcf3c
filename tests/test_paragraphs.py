"""Paragraph operators on small inputs: nulls, empty and blank texts, and segments against their definition."""

from pyspark.sql import functions as F

from sedge.operators import paragraphs as P


def test_segments_keep_every_line_in_order():
    text = "\n".join(["intro " * 3, "# a", "x" * 30, "y" * 30, "# b", "z" * 90, "w", "# c", "end"])
    found = P.segments_of(text, 40)
    assert "\n".join(found) == text
    assert found[1].startswith("# b") or found[0].count("#") == 1
    assert all(len(s) <= 60 or "\n" not in s for s in found)
    assert P.segments_of("") == [] and P.segments_of("short", 40) == ["short"]


def test_segments_skip_placeholders_and_short_ones(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a" * 60), (5, "b" * 60 + P.PLACEHOLDER)], "doc_id long, text string")
    assert {r["doc_id"]: r["route"] for r in P.review_segments(docs).collect()} == {3: "skip", 4: "review", 5: "skip"}


def test_roles_of_nulls_and_blank_lines(spark):
    rows = spark.createDataFrame([(None, None), ("Heading 3", "x"), ("TOC 1", "x"), (None, "　 "), (None, "1.1 Scope"), (None, "text")], "style string, text string")
    got = [r[0] for r in rows.select(P.style_role(F.col("style"), F.col("text"))).collect()]
    assert got == ["empty", "heading_3", "toc", "empty", "heading_2", "body"]


def test_date_pairs(spark):
    rows = spark.createDataFrame([(1, 0, "  甲发布"), (1, 1, "乙实施"), (1, 2, "2022-06-30发布"), (1, 3, "x"), (2, 0, "甲发布")], "doc_id long, pos int, line string")
    assert sorted(tuple(r) for r in P.merge_date_lines(rows).collect()) == [(1, 0, "  甲发布 乙实施"), (1, 2, "2022-06-30发布"), (1, 3, "x"), (2, 0, "甲发布")]
