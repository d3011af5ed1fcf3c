"""Style configurations: errors, defaults, differences and merges on hand-made JSON."""

from pyspark.sql import functions as F

from sedge.operators import styles

FONT = '{"family": "Arial", "size_pt": 12}'


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "k int, config string")


def test_errors(spark):
    given = {
        f'{{"body_style": {{"font": {FONT}}}}}': [],
        f'{{"body_style": {{"font": {FONT}, "keep_together": "ON", "line_spacing": " 1e1 "}}, "unknown": [1]}}': [],
        f'{{"body_style": {{"font": {FONT}, "keep_together": 0.5, "line_spacing": "1 0"}}}}': ["[body_style -> line_spacing] Input should be a valid number, unable to parse string as a number", "[body_style -> keep_together] Input should be a valid boolean, unable to interpret input"],
        f'{{"body_style": {{"font": {FONT}}}, "heading_styles": [{{"font": {FONT}, "level": "7"}}, {{"font": {FONT}, "level": "2.5"}}, {{"font": {FONT}, "level": 1, "outline_level": null}}]}}': ["[heading_styles -> 0 -> level] Input should be less than or equal to 6", "[heading_styles -> 1 -> level] Input should be a valid integer, unable to parse string as an integer"],
        '{"body_style": null, "list_style": null}': ["[body_style] Input should be a valid dictionary"],
        "": ["[] Input should be a valid dictionary"],
        None: ["[] Input should be a valid dictionary"],
    }
    rows = styles.validate_style(texts(spark, given), "config").orderBy("k").select(styles.fault_texts(F.col("faults")).alias("e")).collect()
    assert [r.e for r in rows] == list(given.values())
    assert styles.validate_style(texts(spark, [None]).where("false"), "config").count() == 0


def test_defaults_keep_what_is_given(spark):
    rows = [f'{{"body_style": {{"font": {FONT}, "line_spacing": "2", "keep_together": "on"}}, "heading_styles": [{{"font": {FONT}, "level": 3, "alignment": "right"}}], "page_layout": {{"gutter_cm": 9}}}}', "{}", "[1]", None]
    a, b, c, d = styles.apply_style_defaults(texts(spark, rows), "config").orderBy("k").select("style").collect()
    body, (head,) = a.style.body_style, a.style.heading_styles
    assert (body.line_spacing, body.keep_together, body.widow_control, body.font.color_hex, body.line_spacing_pt) == (2.0, True, True, "#000000", None)
    assert (head.level, head.alignment, head.line_spacing, head.font.bold) == (3, "right", 1.5, False)
    assert (a.style.page_layout.gutter_cm, a.style.page_layout.margin_top_cm, a.style.table_style) == (9.0, 3.7, None)
    assert (b.style.body_style, b.style.heading_styles, b.style.rag_sources, b.style.page_layout.paper_size) == (None, [], [], "A4")
    assert c.style is None and d.style is None


def test_differences(spark):
    one, two = '{"body_style": {"font": {"bold": true, "size_pt": 12}, "alignment": "left"}}', '{"body_style": {"font": {"bold": 1, "size_pt": 12.0}, "alignment": null}, "page_layout": {"margin_top_cm": 2.50}}'
    pairs = [(one, two), (one, one), (None, one), ("{}", one), (one, "{}"), (None, None), ("[1]", "no")]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = [r["diff"] for r in styles.style_diff(frame, "a", "b").orderBy("k").collect()]
    assert got == ["正文.alignment: left → None; 页面.margin_top_cm: None → 2.5", styles.SAME, styles.CREATED, styles.CREATED, styles.DELETED, styles.DELETED, styles.DELETED]


def test_merge(spark):
    pairs = [('{"a": {"x": 1}, "b": 2}', '{"a": {"y": 1}, "c \\" d": null}'), ("[1]", '{"a": 1}'), (None, None)]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = [r.m for r in frame.select("k", styles.merge_json(F.col("a"), F.col("b")).alias("m")).orderBy("k").collect()]
    assert got == ['{"a":{"y":1},"b":2,"c \\" d":null}', '{"a":1}', "{}"]
    paths = styles.flat_paths(texts(spark, ['{"a": {"b": {"c": {"d": 1}}, "e": []}, "f": {}}']), "k", "config").collect()
    assert {r.path: r.value for r in paths} == {"a.b.c": '{"d":1}', "a.e": "[]"}


def test_quarantine(spark, tmp_path):
    checked = styles.validate_style(texts(spark, [f'{{"body_style": {{"font": {FONT}}}}}', "x"]), "config")
    assert [r.k for r in styles.quarantine(checked, f"{tmp_path}/bad").collect()] == [0]
    assert [(r.k, r.errors) for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [(1, ["[] Input should be a valid dictionary"])]


def test_a_small_file_is_dealt_over_all_cores(spark):
    """A file of few row groups keeps few cores busy, however many splits it has."""
    assert styles._configs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
