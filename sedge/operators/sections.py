"""Sections with levels, tables and images; heading levels; whole tags of tables; edits; pipe tables: expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.operators import cleaning, lines as L
from sedge.operators.paragraphs import image_paths

#: Headings, the name of a text without any, tags of a table and what is said of them (fixed values).
HEADING, UNTITLED = r"(?mdU)^(#{1,6})\s+(.+)$", "(无标题)"
TAGS, ISSUE = ("table", "tr", "td", "th"), "<{}> 标签不匹配: 开 {} 个, 闭 {} 个"
#: Roles that make a line no heading, whatever its number says (fixed values).
NO_LEVEL = ("appendix_title", "appendix_clause_5", "appendix_clause_4", "appendix_clause_3", "appendix_clause_2", "table_caption")


def extract_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, section (from 0), level, heading, content, tables, images of every document's sections.

    A section runs from its heading to the next; text before the first heading belongs to none. A text without headings is
    one section of level 1 with its content as it is, unless it is blank. Null and blank texts have no sections.
    """
    text = F.col("_t")
    rows = docs.select(id_col, F.col(text_col).alias("_t"))
    marks, heads = (F.regexp_extract_all(text, F.lit(HEADING), F.lit(g)) for g in (1, 2))
    parts = F.slice(F.split(text, HEADING, -1), 2, 1 << 30)
    some = F.transform(
        F.arrays_zip(marks.alias("m"), heads.alias("h"), parts.alias("p")),
        lambda x: F.struct(F.length(x["m"]).alias("level"), L.stripped(x["h"]).alias("heading"), L.stripped(x["p"]).alias("content")),
    )
    whole = F.array(F.struct(F.lit(1).alias("level"), F.lit(UNTITLED).alias("heading"), text.alias("content")))
    found = F.when(F.size(marks) > 0, some).when(L.stripped(text) != "", whole)
    out = rows.select(id_col, F.posexplode(found).alias("section", "_s")).select(id_col, F.col("section").cast("long").alias("section"), "_s.*")
    return out.withColumn("tables", F.regexp_extract_all("content", F.lit(cleaning.TABLE), F.lit(0))).withColumn("images", image_paths(F.col("content")))


def heading_level(line: Column) -> Column:
    """1 to 5 by a line's number or name; null for appendix lines, table captions and text."""
    text, roles = L.stripped(line), dict(L.ROLES)
    fits = lambda role: text.rlike("(?U)" + roles[role])
    level = F.when(fits(NO_LEVEL[0]), None)
    for role in NO_LEVEL[1:]:
        level = level.when(fits(role), None)
    level = level.when(fits("preface"), 1)
    for n in range(5, 0, -1):
        level = level.when(fits(f"heading_{n}"), n)
    return level.cast("int")


def table_integrity(tables: DataFrame, html: str = "table_html") -> DataFrame:
    """The rows with the opening and closing tags of each kind, the issues found and whether there are none.

    `<th` also counts `<thead`. A null table has null counts, no issues and is not whole.
    """
    low, issues = F.lower(html), []
    counts = {}
    for tag in TAGS:
        opened, closed = F.regexp_count(low, F.lit(f"<{tag}")).cast("long"), F.regexp_count(low, F.lit(f"</{tag}>")).cast("long")
        counts |= {f"{tag}_open": opened, f"{tag}_close": closed}
        said = F.format_string(ISSUE.format(tag, "%d", "%d"), opened, closed)
        issues.append(F.when(opened != closed, said))
    out = tables.withColumns(counts | {"issues": F.array_compact(F.array(*issues))})
    return out.withColumn("whole", F.col(html).isNotNull() & (F.size("issues") == 0))


def apply_text_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id and text of every document after its edit (doc_id, action, needle, position, content), one a document at most.

    append; replace the first `needle`; insert at the beginning, at the end, or below the line in which `position` first
    occurs, whatever its case. Parts are two line feeds apart. What finds no place is appended, as is an edit of another
    or no action; a null position is the end, null content and needle are empty. Documents without an edit stay.
    """
    given = edits.select("doc_id", F.coalesce("action", F.lit("append")).alias("_a"), F.coalesce("needle", F.lit("")).alias("_n"), F.coalesce("position", F.lit("end")).alias("_p"), F.coalesce("content", F.lit("")).alias("_c"))
    met = docs.select("doc_id", "text").join(given.hint("merge"), "doc_id", "left")
    text, action, needle, place, content, gap = F.col("text"), F.col("_a"), F.col("_n"), F.col("_p"), F.col("_c"), F.lit("\n\n")
    old = F.coalesce(text, F.lit(""))
    append = F.concat(old, gap, content)
    at = F.instr(old, needle)
    replaced = F.concat(F.left(old, at - 1), content, F.substring(old, at + F.length(needle), F.length(old)))
    # What follows the place: the text behind its first match, whatever the case.
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.replace(place, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    behind = F.when(place == "", old).otherwise(F.get(F.split(old, pattern, 2), F.lit(1)))
    kept = F.length(old) - F.length(behind) + F.length(F.substring_index(behind, "\n", 1))
    below = F.concat(F.left(old, kept), gap, content, F.substring(old, kept + 1, F.length(old)))
    inserted = F.when(place == "beginning", F.concat(content, gap, old)).when(place == "end", append).otherwise(F.coalesce(below, append))
    new = F.when(action.isNull(), text).when((action == "replace") & (needle != "") & (at > 0), replaced).when(action == "insert", inserted).otherwise(append)
    return met.select("doc_id", new.alias("text"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _headed(s, d):
    text, k = F.col("text"), F.col("doc_id")
    deeper = F.when(k % 5 == 0, F.replace(text, F.lit("#"), F.lit(""))).when(k % 2 == 1, F.replace(text, F.lit("## "), F.lit("#### "))).otherwise(text)
    return cleaning.noisy_texts(s, d).withColumn("text", deeper)


def _sections(s, d):
    found = extract_sections(_headed(s, d))
    return found.select("doc_id", "section", "level", "heading", F.md5("content").alias("md5"), F.size("tables").alias("n_tables"), F.array_join("images", " ").alias("images"))


#: Lines planted for heading levels, by place modulo 13.
_NUMBERED = {1: "附录 A", 2: "A.1 x", 3: "B.1.2 x", 4: "表 3", 5: " 前言 ", 6: "第二章 x", 7: "1 x", 8: "1.2 x", 9: "1.2.3\tx", 10: "1.2.3.4 x", 11: "1.2.3.4.5 x", 12: "2.x"}


def _levels(s, d):
    line = F.col("line")
    for at, text in _NUMBERED.items():
        line = F.when(F.col("pos") % 13 == at, text).otherwise(line)
    return L.noisy_lines(s, d).select("doc_id", "pos", heading_level(line).alias("level"))


def _spoilt_tables(s, d):
    """A table of every line of the orders, one tag left out or doubled by a rule on the line."""
    k = F.col("l_orderkey") % 7
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    head = F.when(k == 1, "<thead><tr><th>part</th></tr></thead>").when(k == 2, "<TR><TH>part</TR>").otherwise("<tr><th>part</th></tr>")
    row = F.when(k == 3, F.concat(F.lit("<tr><td>"), part, F.lit("</td>"))).when(k == 4, F.concat(F.lit("<tr><td>"), part, F.lit("<td>"), supp, F.lit("</td></tr>"))).otherwise(F.concat(F.lit("<tr><td>"), part, F.lit("</td></tr>")))
    html = F.concat(F.lit("<table>"), head, row, F.when(k == 5, "").otherwise("</table>"))
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", html.alias("table_html"))


def _integrity(s, d):
    return table_integrity(_spoilt_tables(s, d)).drop("table_html").withColumn("issues", F.array_join("issues", "; "))


def _edits(s, d):
    k = F.col("doc_id") % 8
    action = F.when(k.isin(0, 5), "append").when(k.isin(1, 7), "replace").when(k == 6, "turn").otherwise("insert")
    needle = F.when(k == 1, "the").when(k == 7, "@@nowhere@@")
    position = F.when(k == 2, "beginning").when(k == 4, "THE ")
    return _docs(s, d).where("doc_id % 9 <> 8").select("doc_id", action.alias("action"), needle.alias("needle"), position.alias("position"), F.when(k != 5, "<edit>").alias("content"))


QUERIES = {
    "extract_sections": _sections,
    "heading_level": _levels,
    "table_integrity": _integrity,
    "apply_text_edits": lambda s, d: apply_text_edits(_docs(s, d), _edits(s, d)).select("doc_id", F.md5("text").alias("md5")),
}

_HEADING = r"(?m)^(#{1,6})\s+(.+)$"
_LINE = "CASE pos % 13 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _NUMBERED.items()) + " ELSE line END"
_N = "[0-9]+"
_LEVEL = f"""CASE WHEN regexp_matches(t, '^附录\\s*[A-Z]') OR regexp_matches(t, '^[A-Z]([.]{_N}){{1,4}}\\s+\\S') OR regexp_matches(t, '^表\\s*[A-Z]?[.]?[0-9]') THEN NULL
WHEN t IN ('前言', '引言', '参考文献') OR regexp_matches(t, '^第[一二三四五六七八九十]+\\s*(法|部分|章|节)') THEN 1
WHEN regexp_matches(t, '^{_N}([.]{_N}){{0,4}}\\s+\\S') THEN CAST(len(string_split(regexp_extract(t, '^[0-9.]+'), '.')) AS INT) END"""
_TABLES = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 7 AS k FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
1 AS table_open, CASE WHEN k = 5 THEN 0 ELSE 1 END AS table_close, 2 AS tr_open, CASE WHEN k = 3 THEN 1 ELSE 2 END AS tr_close,
CASE WHEN k = 4 THEN 2 ELSE 1 END AS td_open, 1 AS td_close, CASE WHEN k = 1 THEN 2 ELSE 1 END AS th_open, CASE WHEN k = 2 THEN 0 ELSE 1 END AS th_close FROM x)"""
_SAID = ", ".join(f"CASE WHEN {t}_open <> {t}_close THEN '<{t}> 标签不匹配: 开 ' || {t}_open || ' 个, 闭 ' || {t}_close || ' 个' END" for t in TAGS)
ORACLES = {
    "extract_sections": f"""WITH {cleaning._noisy_sql()}, h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, '#', '') WHEN doc_id % 2 = 1 THEN replace(text, '## ', '#### ') ELSE text END AS t FROM texts),
m AS (SELECT doc_id, t, regexp_extract_all(t, '{_HEADING}', 1) AS marks, regexp_extract_all(t, '{_HEADING}', 2) AS heads, string_split_regex(t, '{_HEADING}') AS parts FROM h),
s AS (SELECT doc_id, generate_subscripts(marks, 1) AS k, len(unnest(marks)) AS level, trim(unnest(heads), ' ' || chr(9)) AS heading, trim(unnest(parts[2:]), ' ' || chr(9) || chr(10)) AS content FROM m WHERE len(marks) > 0
UNION ALL SELECT doc_id, 1, 1, '{UNTITLED}', t FROM m WHERE len(marks) = 0 AND trim(t, ' ' || chr(9) || chr(10)) <> '')
SELECT doc_id, k - 1 AS section, CAST(level AS INT) AS level, heading, md5(content) AS md5, CAST(len(regexp_extract_all(content, '(?is)<table[\\s>].*?</table>')) AS INT) AS n_tables, coalesce(array_to_string(regexp_extract_all(content, '!\\[.*?\\]\\((.*?)\\)', 1), ' '), '') AS images FROM s""",
    "heading_level": f"WITH {L.NOISY_SQL}, l AS (SELECT doc_id, pos, trim({_LINE}) AS t FROM lines) SELECT doc_id, pos, {_LEVEL} AS level FROM l",
    "table_integrity": f"WITH {_TABLES} SELECT *, concat_ws('; ', {_SAID}) AS issues, concat_ws('; ', {_SAID}) = '' AS whole FROM c",
    "apply_text_edits": r"""WITH e AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 8 THEN -1 ELSE doc_id % 8 END AS k, instr(text, 'the') AS a, instr(lower(text), 'the ') AS b FROM documents),
f AS (SELECT *, CASE WHEN instr(substr(text, b + 4), chr(10)) > 0 THEN b + 2 + instr(substr(text, b + 4), chr(10)) ELSE length(text) END AS till FROM e)
SELECT doc_id, md5(CASE WHEN k = -1 THEN text WHEN k = 5 THEN text || chr(10) || chr(10) WHEN k = 2 THEN '<edit>' || chr(10) || chr(10) || text
WHEN k = 1 AND a > 0 THEN substr(text, 1, a - 1) || '<edit>' || substr(text, a + 3)
WHEN k = 4 AND b > 0 THEN substr(text, 1, till) || chr(10) || chr(10) || '<edit>' || substr(text, till + 1) ELSE text || chr(10) || chr(10) || '<edit>' END) AS md5 FROM f""",
}
