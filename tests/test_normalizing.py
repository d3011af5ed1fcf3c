"""The change log of normalizing, by hand: joined, dropped and changed lines, and notes of lines that are joined again."""

from pyspark.sql import functions as F

from sedge.operators import normalizing as N


def steps(spark, *texts):
    rows = [(d, p, line) for d, lines in enumerate(texts) for p, line in enumerate(lines)]
    return N.normalize_steps(spark.createDataFrame(rows, "doc_id long, pos int, line string").withColumn("log", F.lit("other")))


def test_changes(spark):
    found = steps(
        spark,
        ["  甲发布", "乙实施", "3.1 分析天平", " 3.2  术语", None],
        ["目次", "1 a", "", "前言", "## 目录", "x", "1  范围", "目录"],
        ["附录 A", "2022-06-30发布", "2022-12-30实施", "3.1", "术语"],
        [""],
    )
    got = sorted(tuple(r) for r in N.changes_of(found).collect())
    assert got == [
        (0, 1, 0, 0, "合并日期行: '甲发布' + '乙实施' → '甲发布 乙实施'"),
        (0, 4, 2, 0, "修正标题空格: '3.1 分析天平' → '3.1  分析天平'"),
        (1, 3, 0, 0, "删除 TOC 起始行: '目次'"),
        (1, 3, 4, 0, "删除 TOC 起始行: '## 目录'"),
        (1, 3, 7, 0, "删除 TOC 起始行: '目录'"),
        (1, 3, 7, 1, "删除 TOC 区域共 6 行"),
        (2, 1, 1, 0, "合并日期行: '2022-06-30发布' + '2022-12-30实施' → '2022-06-30发布 2022-12-30实施'"),
        (2, 2, 0, 0, "合并拆分标题: '附录 A' + '2022-06-30发布 2022-12-30实施' → '附录 A  2022-06-30发布 2022-12-30实施'"),
        (2, 2, 3, 0, "合并拆分标题: '3.1' + '术语' → '3.1  术语'"),
    ]
    left = {}
    for r in found.where("not gone").orderBy("doc_id", "pos").collect():
        left.setdefault(r.doc_id, []).append(r.line)
    assert left == {0: ["  甲发布 乙实施", "3.1  分析天平", " 3.2  术语", None], 1: ["前言", "1  范围"], 2: ["附录 A  2022-06-30发布 2022-12-30实施", "3.1  术语"], 3: [""]}
    logs = {r.doc_id: r.log for r in N.logs_of(found).collect()}
    assert logs == {d: [e for i, *_, e in got if i == d] for d in range(4)}


def test_merged_logs_and_empty_tables(spark):
    rows = spark.createDataFrame([(["a"], ["b", "c"]), (None, ["b"]), (None, None)], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(N.merge_change_logs(F.col("x"), F.col("y"))).collect()] == [["a", "b", "c"], ["b"], []]
    none = spark.createDataFrame([], "doc_id long, pos int, line string")
    assert N.changes_of(N.normalize_steps(none)).count() == 0 and N.logs_of(N.normalize_steps(none)).count() == 0


def test_word_paragraphs(spark):
    """The first pair of dates only; contents only before a preface; no heading joined to a preface; spaces behind any number."""
    texts = [
        ["目次", " 2022-06-30发布", "2022-12-30实施", "甲发布", "乙实施", "前 言", "3.1", "术语 ", "附录 A", "前言", "1 scope", "2  x", None],
        ["目次", "5", "参考文献", ""],
    ]
    rows = [(d, p, line) for d, lines in enumerate(texts) for p, line in enumerate(lines)]
    found = N.normalize_word_steps(spark.createDataFrame(rows, "doc_id long, pos int, line string"))
    left = {}
    for r in found.orderBy("doc_id", "pos").collect():
        left.setdefault(r.doc_id, []).append(r.line)
    assert left == {0: ["前 言", "3.1  术语", "附录 A", "前言", "1  scope", "2  x", None], 1: texts[1]}
    assert {r.doc_id: r.log for r in N.word_logs(found).collect()} == {
        0: ["合并日期行: '2022-06-30发布 2022-12-30实施'", "删除 TOC: 4 个段落 (P[0]-P[3])", "合并拆分标题: 1 处", "修正标题双空格: 1 处"],
        1: [],
    }
