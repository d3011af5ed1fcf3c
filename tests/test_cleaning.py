"""Cleaning rules on small texts, with results written by hand."""

import pytest
from pyspark.sql import functions as F

from sedge.operators import cleaning

CASES = [
    ("spaces", "a  b   c\n  d  e\n", "a b c\n  d e", 2),
    ("spaces", "# a  b\n```\nx  y\n```\nz  z", "# a  b\n```\nx  y\n```\nz z", 1),
    ("spaces", "a \t  b\n   \n　c  d", "a \t b\n   \n　c d", 2),  # the tab parts two runs, a blank line is all indent
    ("spaces", "```\nx  y\n  ```z  z\nq  q\n```open\nr  r", "```\nx  y\n  ```z  z\nq q\n```open\nr  r", 1),
    ("line_breaks", "one\ntwo\nthree", "onetwo\nthree", 1),
    ("line_breaks", "one \n  two\n\nthree.\nfour\n# five", "onetwo\n\nthree.\nfour\n# five", 1),
    ("line_breaks", "```\na\nb\n```\nc\nd", "```\na\nb\n```\ncd", 1),
    ("line_breaks", "a\n```\nb\nc", "a```\nbc", 2),  # a joined fence opens nothing
    ("line_breaks", "```\na\nb", "```\na\nb", 0),
    ("line_breaks", "a\n1.b\nc\n٣.d", "a\n1.bc\n٣.d", 1),
    ("latex", r"$$\\intt x \tag{1}$$ and $a _ {i}$, $ok$", r"$$\int x $$ and $a _{i}$, $ok$", 2),
    ("latex", r"$$\\intt$$ $$\\intt$$", r"$$\int$$ $$\int$$", 2),
    ("spaces", "", "", 0),
    ("line_breaks", "\r\n", "", 0),
    ("latex", None, None, None),
]


@pytest.mark.parametrize("rule", ["spaces", "line_breaks", "latex"])
def test_rules(spark, rule):
    cases = [(i, text, want, n) for i, (r, text, want, n) in enumerate(CASES) if r == rule]
    new, count = cleaning.RULES[rule](F.col("text"))
    got = {r.id: (r.t, r.n) for r in spark.createDataFrame([c[:2] for c in cases], "id int, text string").select("id", new.alias("t"), count.alias("n")).collect()}
    assert got == {i: (want, n) for i, _, want, n in cases}


def test_long_fences(spark):
    """Fenced code of any length is taken in one piece, closed or not."""
    code = "```\n" + "a  b\n" * 200_000
    docs = spark.createDataFrame([(1, code), (2, code + "```\nc  d\ne")], "doc_id int, text string")
    got = {r.doc_id: (r.n_spaces, r.n_line_breaks, r.text[-20:]) for r in cleaning.clean_documents(docs).collect()}
    assert got == {1: (0, 0, code[:-1][-20:]), 2: (1, 1, (code + "```\nc de")[-20:])}


def test_documents(spark):
    """Tables stay as they are; paths are looked up for texts with images only; null and empty texts."""
    docs = spark.createDataFrame(
        [(1, "![a](x)  ![b](y)\n<table><tr><td>a  b</td></tr></table>", "k"), (2, "plain", "k"), (3, None, "k"), (4, "", "k")], "doc_id int, text string, missing string"
    )
    got = {r.doc_id: r for r in cleaning.clean_documents(docs, spark.createDataFrame([("x",)], "path string")).collect()}
    assert got[1].text == "![a](x) ![b]([IMAGE_MISSING])<table><tr><td>a  b</td></tr></table>"
    # A placeholder of a table is joined like any line: the text before it ends no sentence.
    assert (got[1].n_spaces, got[1].n_missing_images, got[1].images_missing) == (1, 1, 1)
    assert (got[2].text, got[2].n_missing_images, got[2].log) == ("plain", 0, [])
    assert (got[3].text, got[3].n_spaces, got[4].text, got[4].n_spaces) == (None, None, "", 0)
    assert cleaning.clean_documents(docs.limit(0), spark.createDataFrame([("x",)], "path string")).count() == 0


def test_fullwidth_counts_every_sign(spark):
    """The class of signs is that of the replaced ones, in a few ranges: a class of single signs is tried sign by sign on every character."""
    from sedge.operators import lines

    texts = [lines.FULL, "a" + lines.FULL + "b", "".join(map(chr, range(0xFF00, 0xFFF0))), "plain (9)", "", None]
    new, n = lines.clean_fullwidth(F.col("text"))
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", new.alias("t"), n.alias("n")).orderBy("id").collect()
    assert [r.n for r in got] == [64, 64, 64, 0, 0, None]
    assert (got[0].t, got[1].t, got[3].t, got[5].t) == (lines.HALF, "a" + lines.HALF + "b", "plain (9)", None)
    assert lines.FULL_CLASS.count("{") <= 8
