"""Paragraph operators: roles by position, cover lines, date pairs, heading spaces, images, review segments, style rules.

All but review_segments are expressions or windows over the table of lines (doc_id, pos, line).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sedge.operators import lines as L
from sedge.workspace import small_batches

#: Patterns of dates, numbered, method and appendix headings, captions (fixed values). (?U): digits and spaces of all scripts.
DATE = r"\d{4}[-/]\d{2}[-/]\d{2}"
HEADINGS = (r"^\d+(\.\d+)*\s+\S", r"^[A-Z]\.\d+(\.\d+)*\s+\S")
METHOD, APPENDIX = r"^第[一二三四五六七八九十百]+法\s", r"^附录\s*[A-Z]"
TABLE_CAPTION, FIGURE_CAPTION = r"^表\s+[A-Z]?\.?\d+", r"^图\s*\d+"
#: Characters of a review: a longer text goes in segments, a shorter segment is left alone (fixed values).
REVIEW, SEGMENT, LEAST, PLACEHOLDER = 15000, 12000, 50, "@@TABLE_PLACEHOLDER_"


def _like(text: Column, *patterns: str) -> Column:
    found = text.rlike("(?U)" + patterns[0])
    for p in patterns[1:]:
        found = found | text.rlike("(?U)" + p)
    return found


def infer_standard(file_name: Column) -> Column:
    """The standard's number at the start of a file name; null without one."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    name = F.replace(F.replace(F.replace(stem, F.lit("_T_"), F.lit("/T ")), F.lit("_Z_"), F.lit("/Z ")), F.lit("_"), F.lit("."))
    return F.nullif(F.replace(L.stripped(F.regexp_extract(name, r"(?iU)^(GB[/\s]*[TZ]?\s*[\d.]+(?:-\d+)?)", 1)), F.lit("/ "), F.lit("/")), F.lit(""))


def date_pairs(rows: DataFrame) -> DataFrame:
    """Lines that end in 发布 before one that ends in 实施: both without a date before it, or both a date and no more.

    The lines with starts, taken (the line before starts), then (the next line, stripped), both (the pair as one, without
    indent) and new, the line after joining. No line can end a pair and begin another, so each pair is told by the next
    line alone.
    """
    line, text = F.col("line"), L.stripped(F.col("line"))
    after = F.lead("line").over(L.by_doc())
    then = L.stripped(after)
    undated = text.endswith("发布") & ~_like(line, DATE + "发布") & then.endswith("实施") & ~_like(after, DATE + "实施")
    dated = _like(text, f"^{DATE}发布$") & _like(then, f"^{DATE}实施$")
    without = lambda t, mark: L.stripped(F.replace(t, F.lit(mark), F.lit("")))
    both = F.concat(without(text, "发布"), F.lit("发布 "), without(then, "实施"), F.lit("实施"))
    indent = F.regexp_extract(line, r"(?U)^(\s*)", 1)
    starts = F.coalesce(undated | dated, F.lit(False))
    out = rows.withColumn("starts", starts).withColumn("new", F.when(~starts, line).when(dated, both).otherwise(F.concat(indent, both)))
    return out.withColumn("both", both).withColumn("then", then).withColumn("taken", F.lag("starts", 1, False).over(L.by_doc()))


def merge_date_lines(rows: DataFrame) -> DataFrame:
    """The lines of date_pairs with each pair as one line."""
    return date_pairs(rows).where("not taken").select("doc_id", "pos", F.col("new").alias("line"))


def fix_heading_spaces(line: Column) -> tuple[Column, Column]:
    """Two spaces between a heading's number and a text in Chinese characters; whether the line changed."""
    parts = r"(?U)^(\d+(?:\.\d+)*)(\s+)([\x{4e00}-\x{9fff}].*)$"
    text = L.stripped(line)
    wrong = text.rlike(parts) & (F.regexp_extract(text, parts, 2) != "  ")
    new = F.concat(F.regexp_extract(line, r"(?U)^(\s*)", 1), F.regexp_extract(text, parts, 1), F.lit("  "), F.regexp_extract(text, parts, 3))
    return F.when(wrong, new).otherwise(line), wrong.cast("long")


def normalize_lines(rows: DataFrame) -> DataFrame:
    """Date pairs, split headings, contents lists, heading spaces, in this order."""
    out = L.remove_toc(L.merge_split_headings(merge_date_lines(rows)))
    return out.withColumn("line", fix_heading_spaces(F.col("line"))[0])


def image_paths(text: Column) -> Column:
    """Targets of all images in marks, then of all image tags."""
    marks = F.regexp_extract_all(text, F.lit(r"(?d)!\[.*?\]\((.*?)\)"), F.lit(1))
    return F.concat(marks, F.regexp_extract_all(text, F.lit("(?i)<img[^>]+src=[\"']([^\"']+)[\"']"), F.lit(1)))


def positional_role(rows: DataFrame) -> DataFrame:
    """The role of each line by its place: before the cover, cover, preface, body title, headings, captions, formula, body, empty."""
    doc = W.partitionBy("doc_id")
    text, i, start, preface = F.col("text"), F.col("i"), F.col("start"), F.col("preface")
    out = rows.withColumn("text", L.stripped(F.col("line"))).withColumn("i", F.row_number().over(L.by_doc()) - 1)
    out = out.withColumn("start", F.coalesce(F.min(F.when((i < 30) & text.contains("中华人民共和国国家标准"), i)).over(doc), F.lit(0)))
    out = out.withColumn("preface", F.coalesce(F.min(F.when((i >= start + 3) & (i < start + 12) & text.isin("前言", "前 言"), i)).over(doc), F.lit(-1)))
    out = out.withColumn("next", F.first(F.when(text != "", text), ignorenulls=True).over(L.by_doc().rowsBetween(1, 4)))
    out = out.withColumn("chapter", F.coalesce(F.max((i > 0) & _like(text, r"^1\s+\S")).over(L.by_doc().rowsBetween(-49, -1)), F.lit(False)))
    heading = _like(text, *HEADINGS)
    numbered = heading | _like(text, METHOD) | _like(text, APPENDIX)
    named = F.coalesce(_like(F.col("next"), r"^\d+\s+[\x{4e00}-\x{9fff}]"), F.lit(False))
    behind = (preface >= 0) & (i > preface) & ~numbered
    short = (F.length(text) < 30) & ~text.endswith("。") & ~text.endswith("；")
    role = (
        F.when(text == "", "empty")
        .when((i < start) & (_like(text, r"^GB[/T ]*\s*\d") | _like(text, r"^[一二三四五六七八九十]+[、．.]")), "pre_cover_title").when(i < start, "pre_cover")
        .when((preface >= 0) & (i < preface) | (preface < 0) & (i < start + 5), "cover").when(i == preface, "preface_title")
        .when(behind & short & named, "body_title")
        .when(behind & ~_like(text, TABLE_CAPTION) & ~_like(text, FIGURE_CAPTION) & ~F.col("chapter"), "preface_body")
        .when(_like(text, METHOD), "method_heading").when(_like(text, APPENDIX), "appendix_heading")
        .when(_like(text, TABLE_CAPTION), "table_caption").when(_like(text, FIGURE_CAPTION), "figure_caption").when(heading, "heading")
        .when(text.startswith("$$") | text.rlike("^[A-Z] = "), "formula").otherwise("body")
    )
    return out.select("doc_id", "pos", role.alias("role"))


def cover_line_class(line: Column) -> Column:
    t = L.stripped(line)
    return F.when(t.contains("国家标准"), "organisation").when(_like(t, r"^GB[/T\s]*\d"), "code").when(_like(t, DATE), "date").when(t.contains("发布") | t.contains("实施"), "issue").when(t.rlike("^(代替|替代)"), "replaces").when(t.rlike("^[A-Z][a-z]+") & (F.length(t) > 20), "english_title").otherwise("other")


def cover_flag(text: Column, size: Column, alignment: Column) -> Column:
    """Whether a paragraph looks like a cover's: 14 points or more, centred, not blank; missing values do not."""
    return F.coalesce((L.stripped(text) != "") & (size >= 14) & (alignment == "center"), F.lit(False))


def border_class(top: Column, bottom: Column, left: Column, right: Column, inside_h: Column, inside_v: Column) -> Column:
    """three-line, double, none or single; a null side is not given."""
    drawn = lambda c: F.coalesce(c != "none", F.lit(False))
    given = F.array_compact(F.array(top, bottom, left, right, inside_h, inside_v))
    three = drawn(top) & drawn(bottom) & ~drawn(left) & ~drawn(right) & ~drawn(inside_v)
    return F.when(F.size(given) == 0, "single").when(three, "three-line").when(F.array_contains(given, "double"), "double").when(F.size(F.array_distinct(given)) == 1, F.when(given[0] == "none", "none").otherwise("single")).otherwise("single")


def style_role(style: Column, text: Column) -> Column:
    """A paragraph's role by its style's name, else by its text, else empty or body."""
    style = F.coalesce(style, F.lit(""))
    level = F.regexp_extract(style, "^[Hh]eading ([1-6])$", 1)
    by_name = F.when(level != "", F.concat(F.lit("heading_"), level)).when(style.rlike("List|list"), "list_item").when(style.rlike("TOC|toc"), "toc").when(style.rlike("Caption|caption"), "caption")
    return F.coalesce(by_name, L.line_role(text), F.when(L.stripped(F.coalesce(text, F.lit(""))) == "", "empty"), F.lit("body"))


#: The slots whose style a role takes, first to last; a level stands for the {} (fixed values).
SLOTS = {
    "heading": ("heading_{}", "body"), "appendix_clause": ("appendix_clause", "heading_{}", "body"), "preface": ("preface", "heading_1", "body"), "appendix_title": ("appendix_title", "heading_1", "body"),
    "list_item": ("list", "body"), "caption": ("caption", "body"), "table_caption": ("table_caption", "caption", "body"), "figure_caption": ("caption", "body"),
    "method_heading": ("body",), "cover_marker": ("body",), "toc": ("body",), "body": ("body",),
}


def style_slot(role: Column, slots: Column) -> Column:
    """The slot that styles a role: the first of its chain that is among the given ones, else the body; null for other roles and for empty."""
    level, kind = F.regexp_extract(role, "_([0-9])$", 1), F.regexp_replace(role, "_[0-9]$", "")
    found = F.lit(None).cast("string")
    for name, chain in reversed(SLOTS.items()):
        tries = [F.format_string(slot.replace("{}", "%s"), level) if "{}" in slot else F.lit(slot) for slot in chain[:-1]]
        found = F.when(kind == name, F.coalesce(*(F.when(F.array_contains(slots, x), x) for x in tries), F.lit(chain[-1]))).otherwise(found)
    return found


def style_bucket(role: Column, slot: Column) -> Column:
    """Where a styled role is counted: headings or paragraphs; a heading, preface or appendix title left to the body is unstyled."""
    fallen = role.rlike("^(heading_[0-9]|preface|appendix_title)$") & (slot == "body")
    heading = role.rlike("^(heading_[0-9]|preface|appendix_title|appendix_clause_[0-9]|method_heading)$")
    return F.when(slot.isNull(), None).when(fallen, "unstyled").when(heading, "headings").otherwise("paragraphs")


def style_report_counts(rows: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Headings, paragraphs, unstyled headings, empty lines and tables of every document in rows (doc_id, role, slots).

    tables: (doc_id) a row a table, none without it. Rows of a null or unknown role count nowhere.
    """
    slotted = rows.withColumn("b", style_bucket(F.col("role"), style_slot(F.col("role"), F.col("slots"))))
    counts = slotted.groupBy("doc_id").agg(*(F.count_if(F.col("b") == b).alias(b) for b in ("headings", "paragraphs", "unstyled")), F.count_if(F.col("role") == "empty").alias("empty"))
    if tables is None:
        return counts.withColumn("tables", F.lit(0).cast("long"))
    held = tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(held.hint("merge"), "doc_id", "left").withColumn("tables", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


def review_route(text: Column) -> Column:
    """segmented, skip or review."""
    return F.when(F.length(text) > REVIEW, "segmented").when(F.contains(text, F.lit(PLACEHOLDER)), "skip").otherwise("review")


def segments_of(text: str, most: int = SEGMENT) -> list[str]:
    """Cut before a heading once over `most` characters are met; a segment over half as much again is cut between lines."""

    def cut(rows: list[str], ends) -> list[list[str]]:
        out, size = [], 0
        for row in rows:
            if not out or ends(row, size):
                out.append([])
                size = 0
            out[-1].append(row)
            size += len(row) + 1
        return out

    found = []
    for rows in cut(text.splitlines(), lambda row, size: size > most and row.strip().startswith("#")):
        whole = sum(map(len, rows)) + len(rows) - 1
        parts = cut(rows, lambda row, size: size + len(row) + 1 > most) if whole > most * 1.5 else [rows]
        found += ["\n".join(p) for p in parts]
    return found


def review_segments(docs: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Segments of every document in order, and how each is treated. Null and empty texts have none."""
    small_batches(docs.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, s) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, s in enumerate(segments_of(t, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "text"])

    found = docs.select("doc_id", "text").where("text is not null").mapInPandas(split, "doc_id long, segment long, text string")
    return found.withColumn("route", F.when(F.contains("text", F.lit(PLACEHOLDER)) | (F.length("text") < LEAST), "skip").otherwise("review"))


def review_summary(segments: DataFrame) -> DataFrame:
    """Segments, changes and marked errors of every document."""
    return segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("changes"), F.lit(0)).cast("long").alias("changes"), F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"))


#: Lines put into the documents at places by a rule, so that every pattern occurs (pos modulo 9).
_DATED = {1: "  2022-06-30发布", 2: "2022-12-30实施", 4: "  甲发布", 5: "乙实施 ", 6: "2022-06-30发布", 7: "2022-12-30实施", 8: "3.1 分析天平"}
_PLACED = {3: "中华人民共和国国家标准", 4: "GB/T 1234", 10: "前言", 13: "范围说明", 14: "2  总则", 16: "1  范围", 18: "表 A.1", 19: "图 2", 20: "第一法 重量", 21: "附录 B", 22: "E = mc", 23: "代替 A", 24: "Determination of moisture in food"}


def _with(given: dict, place: Column) -> Column:
    line = F.col("line")
    for at, text in given.items():
        line = F.when(place == at, text).otherwise(line)
    return line


def _dated(s, d):
    return L.noisy_lines(s, d).withColumn("line", _with(_DATED, F.col("pos") % 9))


def _placed(s, d):
    return L.noisy_lines(s, d).withColumn("line", _with(_PLACED, F.when(F.col("doc_id") % 2 == 0, F.col("pos")).otherwise(F.col("pos") % 25)))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _styled(s, d):
    style = F.when(F.col("pos") % 6 == 0, "Heading 2").when(F.col("pos") % 6 == 1, "List Bullet").when(F.col("pos") % 6 == 2, "Caption")
    return _placed(s, d).select("doc_id", "pos", style_role(style, F.col("line")).alias("role"))


#: Slots given to a document, by its id modulo 4.
_GIVEN = (("preface", "list", "caption", "table_caption", "appendix_title", "appendix_clause", "heading_1", "heading_2", "heading_3", "heading_4", "heading_5"), (), ("heading_1", "caption"), ("heading_2", "appendix_clause", "preface"))


def _slotted(s, d):
    given = F.lit(None).cast("array<string>")
    for k, names in enumerate(_GIVEN):
        given = F.when(F.col("doc_id") % 4 == k, F.array(*map(F.lit, names)).cast("array<string>")).otherwise(given)
    return _styled(s, d).withColumn("slots", given)


def _report(s, d):
    tables = _docs(s, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") % 3)).alias("k")).where("k > 0")
    return style_report_counts(_slotted(s, d), tables)


def _borders(s, d):
    side = lambda n: F.when(F.col("p_partkey") % n == 0, "none").when(F.col("p_size") % n == 1, "double").when(F.col("p_size") % n != 2, "single")
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", border_class(*map(side, (7, 5, 2, 2, 3, 2))).alias("border"))


def _standards(s, d):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("GB_T_"), n, F.lit("_13-2008.docx"))).when(k % 4 == 1, F.concat(F.lit("GB "), n, F.lit(".225-2016CN.pdf"))).when(k % 4 == 2, F.concat(F.lit("gb/ T "), n, F.lit(".md"))).otherwise(F.concat(F.lit("note_"), n, F.lit(".md")))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", infer_standard(name).alias("standard"))


def _images(s, d):
    text = F.concat("text", F.lit(' <IMG class=x src="'), "source", F.lit('.jpg"> ![a]('), F.col("doc_id").cast("string"), F.lit(".png)"))
    return _docs(s, d).select("doc_id", F.posexplode(image_paths(text)).alias("k", "path"))


def _fixed(s, d):
    new, n = fix_heading_spaces(F.col("line"))
    return _dated(s, d).select("doc_id", "pos", new.alias("line"), n.alias("n"))


def _summary(s, d):
    seg = review_segments(_docs(s, d), 200)
    return review_summary(seg.withColumn("changes", F.when(F.col("route") == "review", F.lit(1)).otherwise(0)).withColumn("errors", F.regexp_count("text", F.lit("the")))).select("doc_id", "errors")


QUERIES = {
    "infer_standard_from_filename": _standards,
    "merge_date_lines": lambda s, d: merge_date_lines(_dated(s, d)),
    "fix_heading_spaces": _fixed,
    "normalize_pipeline": lambda s, d: normalize_lines(_dated(s, d)),
    "extract_images": _images,
    "positional_roles": lambda s, d: positional_role(_placed(s, d)),
    "cover_line_class": lambda s, d: _placed(s, d).select("doc_id", "pos", cover_line_class(F.col("line")).alias("cls")),
    "cover_flag": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", cover_flag(F.col("p_name"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "center")).alias("cover")),
    "border_class": _borders,
    "style_role": _styled,
    "style_role_fallback": lambda s, d: _slotted(s, d).select("doc_id", "pos", "role", style_slot(F.col("role"), F.col("slots")).alias("slot")),
    "style_report_counts": _report,
    "review_routing": lambda s, d: _docs(s, d).select("doc_id", review_route(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("@@TABLE_PLACEHOLDER_0@@"))).otherwise(F.col("text"))).alias("route")),
    "review_segments": lambda s, d: review_segments(_docs(s, d)).select("doc_id", "segment", "route", F.md5("text").alias("md5")),
    "review_summary": _summary,
}


def _overlay(given: dict, place: str) -> str:
    return f"CASE {place} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in given.items()) + " ELSE line END"


_DATED_SQL = f"{L.NOISY_SQL}, dated AS (SELECT doc_id, pos, {_overlay(_DATED, 'pos % 9')} AS line FROM lines)"
_PLACED_SQL = f"{L.NOISY_SQL}, placed AS (SELECT doc_id, pos, {_overlay(_PLACED, 'CASE WHEN doc_id % 2 = 0 THEN pos ELSE pos % 25 END')} AS line FROM lines)"
_MERGED = f"""{_DATED_SQL}, a AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM dated),
b AS (SELECT *, coalesce(trim(line) LIKE '%发布' AND NOT regexp_matches(line, '{DATE}发布') AND trim(nxt) LIKE '%实施' AND NOT regexp_matches(nxt, '{DATE}实施'), false) AS u, coalesce(regexp_full_match(trim(line), '{DATE}发布') AND regexp_full_match(trim(nxt), '{DATE}实施'), false) AS v FROM a),
c AS (SELECT *, lag(u OR v) OVER (PARTITION BY doc_id ORDER BY pos) AS taken, trim(replace(trim(line), '发布', '')) || '发布 ' || trim(replace(trim(nxt), '实施', '')) || '实施' AS m FROM b),
merged AS (SELECT doc_id, pos, CASE WHEN v THEN m WHEN u THEN regexp_extract(line, '^\\s*') || m ELSE line END AS line FROM c WHERE NOT coalesce(taken, false))"""
_H = r"^(\d+(?:\.\d+)*)(\s+)([\x{4e00}-\x{9fff}].*)$"
_WRONG = f"coalesce(regexp_matches(trim(line), '{_H}') AND regexp_extract(trim(line), '{_H}', 2) <> '  ', false)"
_FIX = f"CASE WHEN {_WRONG} THEN regexp_extract(line, '^\\s*') || regexp_extract(trim(line), '{_H}', 1) || '  ' || regexp_extract(trim(line), '{_H}', 3) ELSE line END"
_SPLIT = L.ORACLES["merge_split_headings"].removeprefix(f"WITH RECURSIVE {L.NOISY_SQL}, ").replace("FROM lines WINDOW", "FROM merged WINDOW").replace(" SELECT o.doc_id, pos, CASE", ", heads AS (SELECT o.doc_id, pos, CASE") + ")"
_TOC = L.ORACLES["remove_toc"].removeprefix(f"WITH {L.NOISY_SQL}, ").replace("FROM lines)", "FROM heads)").replace("SELECT doc_id, pos, line FROM s", f"SELECT doc_id, pos, {_FIX} AS line FROM s")
_NUM = " OR ".join(f"regexp_matches(t, '{p}')" for p in (*HEADINGS, METHOD, APPENDIX))
_ROLE_SQL = f"""{_PLACED_SQL}, a AS (SELECT *, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM placed),
b AS (SELECT *, coalesce(min(i) FILTER (i < 30 AND contains(t, '中华人民共和国国家标准')) OVER (PARTITION BY doc_id), 0) AS s FROM a),
c AS (SELECT *, coalesce(min(i) FILTER (i >= s + 3 AND i < s + 12 AND t IN ('前言', '前 言')) OVER (PARTITION BY doc_id), -1) AS p, first_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS nx, coalesce(bool_or(i > 0 AND regexp_matches(t, '^1\\s+\\S')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING), false) AS ch FROM b),
e AS (SELECT *, p >= 0 AND i > p AND NOT ({_NUM}) AS behind FROM c)
SELECT doc_id, pos, CASE WHEN t = '' THEN 'empty' WHEN i < s AND (regexp_matches(t, '^GB[/T ]*\\s*\\d') OR regexp_matches(t, '^[一二三四五六七八九十]+[、．.]')) THEN 'pre_cover_title' WHEN i < s THEN 'pre_cover' WHEN (p >= 0 AND i < p) OR (p < 0 AND i < s + 5) THEN 'cover' WHEN i = p THEN 'preface_title'
WHEN behind AND length(t) < 30 AND t NOT LIKE '%。' AND t NOT LIKE '%；' AND coalesce(regexp_matches(nx, '^\\d+\\s+[\\x{{4e00}}-\\x{{9fff}}]'), false) THEN 'body_title' WHEN behind AND NOT regexp_matches(t, '{TABLE_CAPTION}') AND NOT regexp_matches(t, '{FIGURE_CAPTION}') AND NOT ch THEN 'preface_body'
WHEN regexp_matches(t, '{METHOD}') THEN 'method_heading' WHEN regexp_matches(t, '{APPENDIX}') THEN 'appendix_heading' WHEN regexp_matches(t, '{TABLE_CAPTION}') THEN 'table_caption' WHEN regexp_matches(t, '{FIGURE_CAPTION}') THEN 'figure_caption' WHEN {' OR '.join(f"regexp_matches(t, '{p}')" for p in HEADINGS)} THEN 'heading' WHEN t LIKE '$$%' OR regexp_matches(t, '^[A-Z] = ') THEN 'formula' ELSE 'body' END AS role FROM e"""
_STYLED = f"{_PLACED_SQL}, st AS (SELECT doc_id, pos, coalesce(CASE pos % 6 WHEN 0 THEN 'heading_2' WHEN 1 THEN 'list_item' WHEN 2 THEN 'caption' END, {L._ROLE}, CASE WHEN trim(line) = '' THEN 'empty' END, 'body') AS role FROM placed)"
_GIVEN_SQL = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN CAST({list(names)} AS VARCHAR[])" for k, names in enumerate(_GIVEN)) + " END"
_HAS = lambda slot: f"list_contains(slots, {slot})"
_SLOTTED = f"""{_STYLED}, sg AS (SELECT *, {_GIVEN_SQL} AS slots FROM st), sl AS (SELECT *, role LIKE 'heading%' OR role LIKE 'appendix%' OR role IN ('preface', 'method_heading') AS head, CASE
WHEN role = 'empty' THEN NULL WHEN role LIKE 'heading%' AND {_HAS("role")} THEN role
WHEN role LIKE 'appendix_clause%' THEN CASE WHEN {_HAS("'appendix_clause'")} THEN 'appendix_clause' WHEN {_HAS("'heading_' || right(role, 1)")} THEN 'heading_' || right(role, 1) ELSE 'body' END
WHEN role IN ('preface', 'appendix_title') THEN CASE WHEN {_HAS("role")} THEN role WHEN {_HAS("'heading_1'")} THEN 'heading_1' ELSE 'body' END
WHEN role = 'list_item' AND {_HAS("'list'")} THEN 'list' WHEN role = 'table_caption' AND {_HAS("role")} THEN role
WHEN role IN ('caption', 'table_caption', 'figure_caption') AND {_HAS("'caption'")} THEN 'caption' ELSE 'body' END AS slot FROM sg)"""
_SIDES = ", ".join(f"CASE WHEN p_partkey % {n} = 0 THEN 'none' WHEN p_size % {n} = 1 THEN 'double' WHEN p_size % {n} <> 2 THEN 'single' END AS {c}" for c, n in zip("tblrhv", (7, 5, 2, 2, 3, 2), strict=True))

ORACLES = {
    "infer_standard_from_filename": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'GB/T ' || p_partkey || '.13-2008' WHEN 1 THEN 'GB ' || p_partkey || '.225-2016' WHEN 2 THEN 'gb/T ' || p_partkey END AS standard FROM part",
    "merge_date_lines": f"WITH {_MERGED} SELECT * FROM merged",
    "fix_heading_spaces": f"WITH {_DATED_SQL} SELECT doc_id, pos, {_FIX} AS line, CAST({_WRONG} AS BIGINT) AS n FROM dated",
    "normalize_pipeline": f"WITH RECURSIVE {_MERGED}, {_SPLIT}, {_TOC}",
    "extract_images": r"""WITH t AS (SELECT doc_id, text || ' <IMG class=x src="' || source || '.jpg"> ![a](' || doc_id || '.png)' AS t FROM documents), p AS (SELECT doc_id, list_concat(regexp_extract_all(t, '!\[.*?\]\((.*?)\)', 1), regexp_extract_all(t, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1)) AS x FROM t) SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS k, unnest(x) AS path FROM p""",
    "positional_roles": f"WITH {_ROLE_SQL}",
    "cover_line_class": f"WITH {_PLACED_SQL}, a AS (SELECT *, trim(line) AS t FROM placed) SELECT doc_id, pos, CASE WHEN contains(t, '国家标准') THEN 'organisation' WHEN regexp_matches(t, '^GB[/T\\s]*\\d') THEN 'code' WHEN regexp_matches(t, '{DATE}') THEN 'date' WHEN contains(t, '发布') OR contains(t, '实施') THEN 'issue' WHEN regexp_matches(t, '^(代替|替代)') THEN 'replaces' WHEN regexp_matches(t, '^[A-Z][a-z]+') AND length(t) > 20 THEN 'english_title' ELSE 'other' END AS cls FROM a",
    "cover_flag": "SELECT p_partkey, coalesce(trim(p_name) <> '' AND p_size >= 14, false) AND p_partkey % 2 = 0 AS cover FROM part",
    "border_class": f"WITH b AS (SELECT p_partkey, {_SIDES} FROM part), g AS (SELECT *, list_filter([t, b, l, r, h, v], lambda x: x IS NOT NULL) AS s FROM b) SELECT p_partkey, CASE WHEN len(s) = 0 THEN 'single' WHEN t <> 'none' AND b <> 'none' AND coalesce(l, 'none') = 'none' AND coalesce(r, 'none') = 'none' AND coalesce(v, 'none') = 'none' THEN 'three-line' WHEN list_contains(s, 'double') THEN 'double' WHEN len(list_filter(s, lambda x: x <> 'none')) = 0 THEN 'none' ELSE 'single' END AS border FROM g",
    "style_role": f"WITH {_STYLED} SELECT * FROM st",
    "style_role_fallback": f"WITH {_SLOTTED} SELECT doc_id, pos, role, slot FROM sl",
    "style_report_counts": f"WITH {_SLOTTED} SELECT doc_id, count(*) FILTER (head AND (slot <> 'body' OR role LIKE 'appendix_clause%' OR role = 'method_heading')) AS headings, count(*) FILTER (NOT head AND role <> 'empty') AS paragraphs, count(*) FILTER (head AND slot = 'body' AND role NOT LIKE 'appendix_clause%' AND role <> 'method_heading') AS unstyled, count(*) FILTER (role = 'empty') AS empty, min(length(text) % 3) AS tables FROM sl JOIN documents USING (doc_id) GROUP BY doc_id",
    "review_summary": "SELECT doc_id, len(regexp_extract_all(text, 'the')) AS errors FROM documents WHERE text <> ''",
    "review_routing": "SELECT doc_id, CASE WHEN length(text) + CASE WHEN doc_id % 3 = 0 THEN 23 ELSE 0 END > 15000 THEN 'segmented' WHEN doc_id % 3 = 0 OR contains(text, '@@TABLE_PLACEHOLDER_') THEN 'skip' ELSE 'review' END AS route FROM documents",
}
