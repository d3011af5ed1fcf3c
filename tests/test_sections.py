"""Sections, levels, tags, edits, style slots and limits against plain Python and by hand."""

import datetime
import re

from pyspark.sql import functions as F

from sedge.operators import batches, documents, paragraphs, sections

TEXTS = [
    "before\n# A\n\n\nx\n## B  \n![p](a.png) <table a=1><tr></tr></table>\n###### C\n####### no\n#no", "plain\n#no\n", "  \n\t", "", None, "# \n\nnext", "#\nnext\n\n# last", "## only", "a\r\n# b\r\nc", "文 # x\n#　全 \n😀 y",
]


#: (level, heading, content) of the sections of each text, by hand.
SECTIONS = [
    [(1, "A", "x"), (2, "B", '![p](a.png) <table a=1><tr></tr></table>'), (6, "C", "####### no\n#no")], [(1, "(无标题)", "plain\n#no\n")], [], [], [],
    [(1, "next", "")], [(1, "next", ""), (1, "last", "")], [(2, "only", "")], [(1, "b", "c")], [(1, "全", "😀 y")],
]


def test_sections(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, section string")
    got = sections.extract_sections(docs).orderBy("doc_id", "section").collect()
    for k, want in enumerate(SECTIONS):
        assert [(r.level, r.heading, r.content) for r in got if r.doc_id == k] == want, TEXTS[k]
        assert [r.section for r in got if r.doc_id == k] == list(range(len(want)))
    b = next(r for r in got if r.heading == "B")
    assert b.tables == ["<table a=1><tr></tr></table>"] and b.images == ["a.png"]
    assert sections.extract_sections(docs.limit(0)).count() == 0


def test_levels(spark):
    given = {"1 x": 1, "1.2 x": 2, "1.2.3.4.5 x": 5, " 前言 ": 1, "第二章": 1, "附录 A": None, "A.1 x": None, "表 1": None, "1": None, "": None, None: None, "图 1": None, "1.2.3.4.5.6 x": None}
    frame = spark.createDataFrame([(t, v) for t, v in given.items()], "line string, want int")
    assert frame.where(~sections.heading_level(F.col("line")).eqNullSafe(F.col("want"))).collect() == []


def test_integrity(spark):
    given = ["<TABLE><thead><tr><th>a</th></tr></thead></table>", "<table><tr><td>a</td></table>", "", None]
    got = sections.table_integrity(spark.createDataFrame([(t,) for t in given], "table_html string")).collect()
    assert [r.whole for r in got] == [False, False, True, False]
    assert [r.issues for r in got][:2] == [["<th> 标签不匹配: 开 2 个, 闭 1 个"], ["<tr> 标签不匹配: 开 1 个, 闭 0 个"]]


#: (text, action, needle, position, content, result), by hand.
EDITS = [
    ("One\ntwo", "append", None, None, "c", "One\ntwo\n\nc"),
    ("One\ntwo two", "replace", "two", None, "c$1", "One\nc$1 two"),
    ("One", "replace", "", None, "c", "One\n\nc"),
    ("One", "replace", "no", None, "c", "One\n\nc"),
    ("One", "insert", None, "beginning", "c", "c\n\nOne"),
    ("One", "insert", None, None, "c", "One\n\nc"),
    ("One\ntwo THE end\nthree", "insert", None, "the", "c", "One\ntwo THE end\n\nc\nthree"),
    ("😀 a\\Eb (x)\nlast", "insert", None, "A\\eB (X)", "c", "😀 a\\Eb (x)\n\nc\nlast"),
    ("One\nthree", "insert", None, "three", "c", "One\nthree\n\nc"),
    ("One", "insert", None, "four", "c", "One\n\nc"),
    ("One", "turn", None, None, None, "One\n\n"),
    ("One", None, None, None, "c", "One\n\nc"),
    (None, "append", None, None, "c", "\n\nc"),
    ("", "insert", None, "beginning", "c", "c\n\n"),
    ("the\n\n", "insert", None, "the", "c", "the\n\nc\n\n"),
]


def test_edits(spark):
    docs = spark.createDataFrame([(k, e[0], "x") for k, e in enumerate(EDITS)] + [(-1, "as it is", "x")], "doc_id long, text string, action string")
    edits = spark.createDataFrame([(k, *e[1:5]) for k, e in enumerate(EDITS)], "doc_id long, action string, needle string, position string, content string")
    got = {r.doc_id: r.text for r in sections.apply_text_edits(docs, edits).collect()}
    assert got.pop(-1) == "as it is"
    assert [got[k] for k in range(len(EDITS))] == [e[5] for e in EDITS]


def test_style_counts(spark):
    roles = ["preface", "appendix_title", "appendix_clause_2", "method_heading", "heading_1", "heading_2", "body", "toc", "cover_marker", "table_caption", "empty", None, "strange"]
    frame = spark.createDataFrame([(1, r, ["heading_1", "caption"]) for r in roles] + [(2, "heading_1", [])], "doc_id long, role string, slots array<string>")
    got = {r.role: r.slot for r in frame.where("doc_id = 1").select("role", paragraphs.style_slot(F.col("role"), F.col("slots")).alias("slot")).collect()}
    assert got == {"preface": "heading_1", "appendix_title": "heading_1", "appendix_clause_2": "body", "method_heading": "body", "heading_1": "heading_1", "heading_2": "body", "body": "body", "toc": "body", "cover_marker": "body", "table_caption": "caption", "empty": None, None: None, "strange": None}
    counts = paragraphs.style_report_counts(frame, spark.createDataFrame([(1,), (1,)], "doc_id long"))
    assert {tuple(r) for r in counts.select("doc_id", "headings", "paragraphs", "unstyled", "empty", "tables").collect()} == {(1, 5, 4, 1, 1, 2), (2, 0, 0, 1, 0, 0)}


def test_formulas(spark):
    text = "$a\nb$ $$$$ $$c$$ $d$$e$ $f"  # inline: over a line end, and the blank between the last two lone marks
    assert re.findall(r"(?<!\$)\$(?!\$)[^$]+?(?<!\$)\$(?!\$)", text) == ["$a\nb$", "$ $"]
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [(r.blocks, r.inline) for r in documents.doc_features(frame).orderBy("doc_id").collect()] == [(2, 2), (0, 0)]


def test_rate_limit_of_null_keys(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(u, k, at + datetime.timedelta(seconds=k)) for k, u in enumerate([None, None, None, 2**53 + 1, 2**53, 2**53 + 1, 2**53 + 1])]
    got = batches.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz"), 2, 60).orderBy("event_id").collect()
    assert [(r.user_id, r.accepted) for r in got] == [(None, True), (None, True), (None, False), (2**53 + 1, True), (2**53, True), (2**53 + 1, True), (2**53 + 1, False)]
