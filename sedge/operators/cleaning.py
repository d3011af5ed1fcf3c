"""Counted cleaning rules over whole texts, in their order, with tables protected: expressions only.

Each rule takes a text column and gives (new text, count). Only the missing images need a join, of the texts that have
image marks with the inventory of paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sedge.operators import lines as L
from sedge.workspace import Scratch, spread

#: Marks, ends of sentences, beginnings that are never joined, and log lines (fixed values).
IMAGE_MISSING, FORMULA_IMAGE, PLACEHOLDER = "[IMAGE_MISSING]", "[FORMULA_IMAGE]", "@@TABLE_PLACEHOLDER_{}@@"
ENDS = "。？！.?!:：;；"
NO_JOIN = r"[#\-*+>|<]|\d+\."
TABLE, IMAGE = r"(?is)<table[\s>].*?</table>", r"!\[([^\]]*)\]\(([^)]+)\)"
LOGS = {
    "fullwidth": ("全角字符转半角: ", " 处"), "spaces": ("多余空格清理: ", " 处"), "line_breaks": ("OCR 断行修复: ", " 处"), "headings": ("标题格式统一: ", " 处"),
    "latex": ("LaTeX 公式修复: ", " 处"), "missing_images": ("图片路径校验: ", " 个失效图片"), "garbled": ("乱码字符清理: ", " 处"), "lists": ("列表格式修复: ", " 处"),
}
#: White space within a line, for patterns with (?U).
BLANK = r"[^\S\n]"
#: Misread formula commands and what they stand for (fixed values).
LATEX = (
    (r"\\intt", r"\int"), (r"\\intl", r"\int"), (r"\\summ", r"\sum"), (r"\\suM", r"\sum"), (r"\\limm", r"\lim"), (r"\\Iim", r"\lim"), (r"\\fraC", r"\frac"),
    (r"\\f rac", r"\frac"), (r"\\sq rt", r"\sqrt"), (r"\\sqrt[", r"\sqrt["), (r"\\alphaI", r"\alpha"), (r"\\betaI", r"\beta"), (r"\\gammaI", r"\gamma"), (r"_ {", r"_{"), (r"^ {", r"^{"),
)
DROPPED = r"\nonumber"


def one_line_end(text: Column) -> Column:
    """The text with \\n for all line ends that Unicode text knows; an end after the last line goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n|[\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n"), r"\n\z", "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Lambdas see single elements only: an array named inside one would be made anew for each element.


def _interleaved(text: Column, pattern: str, put: Column) -> Column:
    """The text with its k-th match of a pattern replaced by the k-th of put."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), put, lambda part, new: F.concat(part, F.coalesce(new, F.lit("")))), "")


def protect_tables(text: Column) -> tuple[Column, Column]:
    """The text with its k-th table replaced by a placeholder, and the tables."""
    before, after = PLACEHOLDER.split("{}")
    tables = F.regexp_extract_all(text, F.lit(TABLE), F.lit(0))
    return _interleaved(text, TABLE, F.transform(tables, lambda t, i: F.concat(F.lit(before), i.cast("string"), F.lit(after)))), tables


def restore_tables(text: Column, tables: Column) -> Column:
    before, after = PLACEHOLDER.split("{}")
    numbered = F.transform(tables, lambda t, i: F.struct(F.concat(F.lit(before), i.cast("string"), F.lit(after)).alias("mark"), t.alias("html")))
    return F.aggregate(numbered, text, lambda acc, t: F.replace(acc, t["mark"], t["html"]))


def fullwidth(text: Column) -> tuple[Column, Column]:
    return L.clean_fullwidth(text)


def spaces(text: Column) -> tuple[Column, Column]:
    """Runs of spaces after a line's indent become one, but in fenced code and headings; a line counts once.

    The text is cut at its fence lines; every other part lies in fenced code.
    """
    fence = rf"(?mdU)^{BLANK}*```.*"
    # A line's indent, and the rest of a heading, is taken whole, so the second branch meets runs behind it only.
    runs, lines = rf"(?mdU)(^{BLANK}*+(?:#.*)?)|( ) +", rf"(?mdU)^{BLANK}*+(?!#).*? {{2}}.*"

    def cleaned(one: Column) -> Column:
        outside = lambda part, i: F.when(i % 2 == 0, F.struct(F.regexp_replace(part, runs, "$1$2").alias("t"), F.regexp_count(part, F.lit(lines)).alias("n"))).otherwise(F.struct(part.alias("t"), F.lit(0).alias("n")))
        parts = F.transform(F.split(one, fence, -1), outside)
        marks = F.regexp_extract_all(one, F.lit(fence), F.lit(0))
        return bound(parts, lambda x: F.struct(
            F.array_join(F.zip_with(x["t"], marks, lambda part, mark: F.concat(part, F.coalesce(mark, F.lit("")))), "").alias("t"),
            F.aggregate(x["n"], F.lit(0), lambda total, n: total + n).alias("n"),
        ))

    done = bound(one_line_end(text), cleaned)
    return done["t"], done["n"]


def line_breaks(text: Column) -> tuple[Column, Column]:
    """A line that ends no sentence joined to the next, unless that is blank or begins a block; pairs from the top, outside fenced code.

    One scan from the top: at each line either fenced code is taken whole or a pair is joined. A fence that was joined
    to the line before it opens nothing.
    """
    fence = rf"{BLANK}*```[^\n]*+"
    code = rf"^{fence}(?:(?s:.*?)\n{fence}|(?s:.*))"
    pair = rf"^(?!{BLANK}*```)(.*[^\s{ENDS}]){BLANK}*\n{BLANK}*(?!{NO_JOIN})(\S.*)"
    count = lambda x: F.regexp_count(x, F.lit("\n"))

    def joined(one: Column) -> Column:
        return bound(F.regexp_replace(one, f"(?mdU)({code})|{pair}", "$1$2$3"), lambda new: F.struct(new.alias("t"), (count(one) - count(new)).alias("n")))

    done = bound(one_line_end(text), joined)
    return done["t"], done["n"]


def headings(text: Column) -> tuple[Column, Column]:
    """One space between the marks and the text; counted where there was none."""
    return F.regexp_replace(text, r"(?mdU)^(#{1,6}+)[^\S\n]*(.*?)[^\S\n]*$", "$1 $2"), F.regexp_count(text, F.lit("(?md)^#{1,6}+(?! )"))


def _fixed(formula: Column) -> Column:
    for wrong, right in LATEX:
        formula = F.replace(formula, F.lit(wrong), F.lit(right))
    return F.replace(F.regexp_replace(formula, r"\\tag\{[^}]*\}", ""), F.lit(DROPPED), F.lit(""))


def _fixed_formulas(text: Column, pattern: str, mark: str) -> Column:
    """(t, n): the text with its wrong formulas replaced, and their number."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    pairs = F.zip_with(whole, inner, lambda w, f: F.struct(w.alias("w"), f.alias("f"), _fixed(f).alias("new")))
    wrong = F.filter(pairs, lambda x: (x["new"] != x["f"]) & (L.stripped(x["f"]) != ""))
    put = lambda acc, x: F.replace(acc, x["w"], F.concat(F.lit(mark), x["new"], F.lit(mark)))
    return bound(wrong, lambda x: F.struct(F.aggregate(x, text, put).alias("t"), F.size(x).alias("n")))


def latex(text: Column) -> tuple[Column, Column]:
    """Misread commands of block formulas, then of inline ones, and what they may not hold; a formula counts once."""
    inline = r"(?s)(?<!\$)\$(?!\$)(.*?)(?<!\$)\$(?!\$)"
    both = lambda b: bound(_fixed_formulas(b["t"], inline, "$"), lambda i: F.struct(i["t"].alias("t"), (b["n"] + i["n"]).alias("n")))
    done = bound(_fixed_formulas(text, r"(?s)\$\$(.*?)\$\$", "$$"), both)
    return done["t"], done["n"]


def missing_images(text: Column, missing: Column) -> tuple[Column, Column]:
    """Image marks whose path is among the missing ones lose it; counted."""
    whole, alt, path = (F.regexp_extract_all(text, F.lit(IMAGE), F.lit(g)) for g in (0, 1, 2))
    bare = F.transform(alt, lambda a: F.concat(F.lit("!["), a, F.lit(f"]({IMAGE_MISSING})")))
    # A path is missing: its mark in short, else null.
    gone = F.zip_with(path, bare, lambda p, b: F.when(F.array_contains(missing, p), b))
    put = lambda g: F.zip_with(g, whole, lambda b, w: F.coalesce(b, w))
    done = bound(gone, lambda g: F.struct(_interleaved(text, IMAGE, put(g)).alias("t"), F.size(F.array_compact(g)).alias("n")))
    return done["t"], done["n"]


def garbled(text: Column) -> tuple[Column, Column]:
    return L.clean_garbled(text)


def lists(text: Column) -> tuple[Column, Column]:
    """A space after a list mark that has none; the rest loses the white space at its ends; counted."""
    bullets, numbers = r"(?mdU)^(\s*)([-*+])(?! )", r"(?mdU)^(\s*)(\d+\.)(?! )"
    rest = r"[^\S\n]*(.*?)[^\S\n]*$"
    one = F.regexp_replace(text, bullets + rest, "$1$2 $3")
    return F.regexp_replace(one, numbers + rest, "$1$2 $3"), F.regexp_count(text, F.lit(bullets)) + F.regexp_count(one, F.lit(numbers))


RULES = {"fullwidth": fullwidth, "spaces": spaces, "line_breaks": line_breaks, "headings": headings, "latex": latex, "missing_images": missing_images, "garbled": garbled, "lists": lists}


def paths_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2)))


def missing_paths(docs: DataFrame, inventory: DataFrame, id_col: str = "doc_id", paths_col: str = "paths") -> DataFrame:
    """(id, missing): for each document with image paths, those that the inventory (path) does not hold."""
    asked = docs.select(id_col, F.explode(paths_col).alias("path"))
    gone = asked.join(inventory.select("path").distinct().hint("merge"), "path", "left_anti")
    return gone.groupBy(id_col).agg(F.array_sort(F.collect_list("path")).alias("missing"))  # one document's paths


def with_missing(docs: DataFrame, inventory: DataFrame, id_col: str = "doc_id", paths_col: str = "paths") -> DataFrame:
    """The documents with their missing paths; only those that have image paths meet the inventory and are moved."""
    gone = missing_paths(docs, inventory, id_col, paths_col)
    some = docs.where(F.size(paths_col) > 0).join(gone.hint("merge"), id_col, "left")
    nothing = F.array().cast("array<string>")
    rest = docs.where(F.coalesce(F.size(paths_col) == 0, F.lit(True))).withColumn("missing", nothing)
    return some.withColumn("missing", F.coalesce("missing", nothing)).unionByName(rest).drop(paths_col)


def _apply(rows: DataFrame, rule: str, new: Column, n: Column) -> DataFrame:
    # The counts of a null text are null.
    rows = rows.withColumn("_r", F.struct(new.alias("t"), n.alias("n")))
    return rows.withColumn("_t", F.col("_r.t")).withColumn(f"n_{rule}", F.when(F.col("_t").isNotNull(), F.col("_r.n"))).drop("_r")


def clean_documents(docs: DataFrame, inventory: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document cleaned by all rules in order, its tables left as they are: id, text, n_<rule> for each rule, log, and
    the counts images_missing, formulas_preserved and ocr_issues.

    A rule that changes nothing leaves no line in the log; ocr_issues is the number of its lines. A null text stays null
    with null counts. Without an inventory no image is held to be missing, and nothing is written or moved. With one, the
    texts are written once before the images are looked up, so that no rule runs twice. Ids are unique.
    """
    rows = spread(docs.select(id_col, F.col(text_col).alias("_t")))
    protected, tables = protect_tables(F.col("_t"))
    rows = rows.withColumn("_tables", tables).withColumn("_t", protected)
    for rule in RULES:
        if rule != "missing_images":
            rows = _apply(rows, rule, *RULES[rule](F.col("_t")))
        elif inventory is None:
            rows = rows.withColumn("n_missing_images", F.when(F.col("_t").isNotNull(), 0))
        else:
            kept = Scratch(docs.sparkSession, "cleaning").keep(rows.withColumn("_paths", paths_of(F.col("_t"))), "repaired")
            rows = _apply(with_missing(kept, inventory, id_col, "_paths"), rule, *missing_images(F.col("_t"), F.col("missing"))).drop("missing")
    log = F.filter(F.array(*(F.when(F.col(f"n_{r}") > 0, F.concat(F.lit(a), F.col(f"n_{r}").cast("string"), F.lit(b))) for r, (a, b) in LOGS.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("text", restore_tables(F.col("_t"), F.col("_tables"))).withColumn("log", log)
    literal = lambda mark: F.regexp_count("text", F.lit("\\Q" + mark + "\\E"))
    return rows.select(
        id_col, "text", *(F.col(f"n_{r}").cast("long").alias(f"n_{r}") for r in RULES), "log",
        literal(IMAGE_MISSING).cast("long").alias("images_missing"), literal(FORMULA_IMAGE).cast("long").alias("formulas_preserved"), F.size("log").cast("long").alias("ocr_issues"),
    )


#: Faults planted into the documents' lines, by place: (modulus, remainder, where, text).
PLANTS = (
    (7, 0, "before", "##"), (7, 3, "before", "## "), (9, 4, "before", "-"), (13, 4, "after", "\N{REPLACEMENT CHARACTER}"), (11, 6, "before", "\t  "), (17, 5, "set", "```"), (17, 8, "set", "  ``` "),
    (19, 3, "after", r"$$\\intt x \tag{1}$$"), (19, 7, "after", r" $a _ {i}$ and $ok$"), (23, 4, "set", "![pic](images/p1.png) ![other](images/p2.png)"),
    (29, 6, "set", "<table><tr><td>a  b</td></tr></table>"), (31, 9, "set", "-"), (31, 10, "set", "1."), (31, 11, "set", " # h  x"), (31, 12, "set", "-\titem  "), (31, 13, "set", "3.1 word"),
)


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the documents with the faults that the rules repair, a blank line after every fourth."""

    def spoilt(line: Column, p: Column) -> Column:
        wide = "abc0123456789"
        line = F.when(p % 5 == 1, F.replace(line, F.lit(" "), F.lit("  "))).when(p % 5 == 3, F.translate(line, wide, L._fold(wide))).otherwise(line)
        for m, r, where, text in PLANTS:
            here = F.when(p % m == r, F.lit(text))
            put = F.coalesce(here, F.lit(""))
            line = F.coalesce(here, line) if where == "set" else F.concat(put, line) if where == "before" else F.concat(line, put)
        return F.concat(line, F.when(p % 4 == 3, "\n").otherwise(""))

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), spoilt), "\n").alias("text"))


def inventory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("images/p1.png",)], "path string")


def _digest(docs: DataFrame, new: Column, n: Column) -> DataFrame:
    return docs.select("doc_id", F.md5(new).alias("text_md5"), F.length(new).alias("n_chars"), n.cast("long").alias("n"))


def _rule(name):
    return lambda spark, sf_dir: _digest(noisy_texts(spark, sf_dir), *RULES[name](F.col("text")))


def _images(spark, sf_dir):
    docs = Scratch(spark, "images").keep(noisy_texts(spark, sf_dir).withColumn("paths", paths_of(F.col("text"))), "texts")
    return _digest(with_missing(docs, inventory(spark)), *missing_images(F.col("text"), F.col("missing")))


def _pipeline(spark, sf_dir):
    docs = clean_documents(noisy_texts(spark, sf_dir), inventory(spark))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def _report(spark, sf_dir):
    docs = clean_documents(noisy_texts(spark, sf_dir), inventory(spark))
    return docs.withColumn("log", F.array_join("log", "; ")).drop("text")


QUERIES = {"clean_fullwidth_texts": _rule("fullwidth"), "clean_headings_texts": _rule("headings"), "clean_garbled_texts": _rule("garbled")} | {
    "clean_spaces": _rule("spaces"),
    "clean_line_breaks": _rule("line_breaks"),
    "clean_latex": _rule("latex"),
    "clean_missing_images": _images,
    "clean_lists": _rule("lists"),
    "clean_pipeline": _pipeline,
    "cleaning_report": _report,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _noisy_sql() -> str:
    """The same texts for DuckDB, line by line."""
    line = f"CASE WHEN p % 5 = 1 THEN replace(line, ' ', '  ') WHEN p % 5 = 3 THEN translate(line, 'abc0123456789', '{L._fold('abc0123456789')}') ELSE line END"
    source = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p, unnest(string_split(text, chr(10))) AS line FROM documents"
    steps = [f"t0 AS (SELECT doc_id, p, {line} AS line FROM ({source}))"]
    for k, (m, r, where, text) in enumerate(PLANTS):
        new = {"set": _quoted(text), "before": f"{_quoted(text)} || line", "after": f"line || {_quoted(text)}"}[where]
        steps.append(f"t{k + 1} AS (SELECT doc_id, p, CASE WHEN p % {m} = {r} THEN {new} ELSE line END AS line FROM t{k})")
    steps.append(f"texts AS (SELECT doc_id, string_agg(CASE WHEN p % 4 = 3 THEN line || chr(10) ELSE line END, chr(10) ORDER BY p) AS text FROM t{len(PLANTS)} GROUP BY doc_id)")
    return ",\n".join(steps)


_WHITE = "chr(9) || ' '"  # the white space that the planted lines hold


def _by_line(x: str, rest: str, line: str, n: str, whole: bool = False) -> str:
    """CTEs x(doc_id, text, n) from {src}: lines x_l, what rest makes of them as x_d, put together again."""
    cut = "text" if whole else r"regexp_replace(text, '\n$', '')"
    return f"""
{x}_l AS (SELECT doc_id, generate_subscripts(string_split({cut}, chr(10)), 1) AS k, unnest(string_split({cut}, chr(10))) AS line FROM {{src}}){rest},
{x}_d AS (SELECT doc_id, k, {line} AS line, {n} AS n FROM {x}_{'z' if rest else 'l'}),
{x} AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text, CAST(sum(n) AS BIGINT) AS n FROM {x}_d GROUP BY doc_id)"""


def _marked(mark: str) -> tuple[str, str]:
    wrong = f"regexp_matches(line, '{mark}($|[^ ])')"
    return f"CASE WHEN {wrong} THEN regexp_extract(line, '{mark}') || ' ' || trim(regexp_replace(line, '{mark}', ''), {_WHITE}) ELSE line END", f"CAST({wrong} AS INT)"


def _fix_sql(m: str) -> str:
    for wrong, right in LATEX:
        m = f"replace({m}, {_quoted(wrong)}, {_quoted(right)})"
    return rf"replace(regexp_replace({m}, '\\tag\{{[^}}]*\}}', '', 'g'), {_quoted(DROPPED)}, '')"


_BLOCKS = rf"list_filter(regexp_extract_all(text, '(?s)\$\$.*?\$\$'), lambda m: {_fix_sql('m')} <> m)"
_masked = "text"  # runs of two and more dollars are no inline marks; the documents hold none over eight
for _n in range(8, 1, -1):
    _masked = f"replace({_masked}, '{'$' * _n}', repeat(chr(1), {_n}))"
_INLINE = rf"list_filter(list_transform(regexp_extract_all({_masked}, '\$[^$]*\$'), lambda m: replace(m, chr(1), '$')), lambda m: {_fix_sql('m')} <> m)"
_GONE = rf"list_filter(regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)'), lambda m: regexp_extract(m, '\]\(([^)]+)\)', 1) <> 'images/p1.png')"
_BULLET, _NUMBER = _marked(r"^\s*[-*+]"), _marked(r"^\s*\d+\.")
_own = f"trim(line, {_WHITE})"
_SQL = {
    "fullwidth": f"\nfullwidth AS (SELECT doc_id, translate(text, '{L.FULL}', '{L.HALF}') AS text, length(text) - length(regexp_replace(text, '[{L.FULL}]', '', 'g')) AS n FROM {{src}})",
    "garbled": "\ngarbled AS (SELECT doc_id, replace(text, chr(65533), '') AS text, length(text) - length(replace(text, chr(65533), '')) AS n FROM {src})",
    "headings": _by_line("headings", "", f"CASE WHEN line LIKE '#%' THEN regexp_extract(line, '^#{{1,6}}') || ' ' || trim(regexp_replace(line, '^#{{1,6}}', ''), {_WHITE}) ELSE line END", "CAST(line LIKE '#%' AND regexp_replace(line, '^#{1,6}', '') NOT LIKE ' %' AS INT)", True),
    "spaces": _by_line(
        "spaces",
        rf""",
spaces_f AS (SELECT *, {_own} LIKE '```%' AS fence FROM spaces_l),
spaces_g AS (SELECT *, fence OR sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY k) % 2 = 1 AS kept FROM spaces_f),
spaces_z AS (SELECT doc_id, k, line, CASE WHEN kept OR {_own} LIKE '#%' THEN line
             ELSE regexp_extract(line, '^\s*') || regexp_replace(ltrim(line, {_WHITE}), ' {{2,}}', ' ', 'g') END AS new FROM spaces_g)""",
        "new", "CAST(new <> line AS INT)",
    ),
    "line_breaks": _by_line(
        "line_breaks",
        rf""",
line_breaks_s AS (SELECT *, {_own} AS own, trim(lead(line) OVER w, {_WHITE}) AS nxt, lead(line) OVER w AS nline FROM line_breaks_l WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
line_breaks_o AS MATERIALIZED (SELECT *, own LIKE '```%' AS fence,
      coalesce(own <> '' AND NOT regexp_matches(own, '[。？！.?!:：;；]$') AND nxt <> '' AND NOT regexp_matches(nxt, '^([#\-*+>|<]|\d+\.)'), false) AS opens FROM line_breaks_s),
line_breaks_k AS (SELECT doc_id, list(CASE WHEN fence THEN 'f' WHEN opens THEN 'o' ELSE '-' END ORDER BY k) AS kinds FROM line_breaks_o GROUP BY doc_id),
-- State of the walk over a text's lines: inside a fence, the line is taken, then one sign a line.
line_breaks_w AS (SELECT doc_id, list_reduce(['00'] || kinds, lambda a, x: CASE WHEN a[2] = '1' THEN a[1] || '0' || a[3:] || 'x' WHEN x = 'f' THEN CASE a[1] WHEN '0' THEN '1' ELSE '0' END || '0' || a[3:] || '-'
      WHEN x = 'o' AND a[1] = '0' THEN '01' || a[3:] || 'j' ELSE a[1] || '0' || a[3:] || '-' END) AS signs FROM line_breaks_k),
line_breaks_z AS (SELECT doc_id, k, line, nline, signs[k + 2] = 'j' AS joins FROM line_breaks_o JOIN line_breaks_w USING (doc_id) WHERE signs[k + 2] <> 'x')""",
        f"CASE WHEN joins THEN rtrim(line, {_WHITE}) || ltrim(nline, {_WHITE}) ELSE line END", "CAST(joins AS INT)",
    ),
    "latex": rf"""
latex_b AS (SELECT doc_id, list_reduce([text] || {_BLOCKS}, lambda acc, m: replace(acc, m, {_fix_sql('m')})) AS text, len({_BLOCKS}) AS n FROM {{src}}),
latex AS (SELECT doc_id, list_reduce([text] || {_INLINE}, lambda acc, m: replace(acc, m, {_fix_sql('m')})) AS text, n + len({_INLINE}) AS n FROM latex_b)""",
    "missing_images": rf"""
missing_images AS (SELECT doc_id, list_reduce([text] || {_GONE}, lambda acc, m: replace(acc, m, regexp_extract(m, '^!\[[^\]]*\]') || '({IMAGE_MISSING})')) AS text, len({_GONE}) AS n FROM {{src}})""",
    "lists": _by_line("lists_b", "", *_BULLET, True) + "," + _by_line("lists_n", "", *_NUMBER, True).replace("{src}", "lists_b") + ",\nlists AS (SELECT doc_id, x.text, b.n + x.n AS n FROM lists_b b JOIN lists_n x USING (doc_id))",
}


def _one(rule: str) -> str:
    return f"WITH {_noisy_sql()}, {_SQL[rule].replace('{src}', 'texts')} SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars, n FROM {rule}"


def _all() -> str:
    """Rules in order over protected texts, as `cleaned`: text with its tables restored, and a count for each rule."""
    table = next(t for _, _, _, t in PLANTS if t.startswith("<table"))
    parts = f"string_split(text, {_quoted(table)})"
    steps, src = [f"guarded AS (SELECT doc_id, {parts}[1] || array_to_string(list_transform({parts}[2:], lambda x, i: '@@TABLE_PLACEHOLDER_' || (i - 1) || '@@' || x), '') AS text FROM texts)"], "guarded"
    for rule in RULES:
        steps.append(_SQL[rule].replace('{src}', src))
        src = rule
    counts = ", ".join(f"{r}.n AS n_{r}" for r in RULES)
    joins = " ".join(f"JOIN {r} USING (doc_id)" for r in list(RULES)[:-1])
    steps.append(f"cleaned AS (SELECT doc_id, regexp_replace({src}.text, '@@TABLE_PLACEHOLDER_\\d+@@', {_quoted(table)}, 'g') AS text, {counts} FROM {src} {joins})")
    return f"WITH {_noisy_sql()}, " + ",\n".join(steps)


def _times(mark: str) -> str:
    return f"CAST((length(text) - length(replace(text, '{mark}', ''))) / {len(mark)} AS BIGINT)"


_log = ", ".join(f"CASE WHEN n_{r} > 0 THEN {_quoted(a)} || n_{r} || {_quoted(b)} END" for r, (a, b) in LOGS.items())
_counts = ", ".join(f"CAST(n_{r} AS BIGINT) AS n_{r}" for r in RULES)
_issues = " + ".join(f"CAST(n_{r} > 0 AS BIGINT)" for r in RULES)
ORACLES = {q: _one(r) for q, r in (("clean_fullwidth_texts", "fullwidth"), ("clean_headings_texts", "headings"), ("clean_garbled_texts", "garbled"))} | {
    f"clean_{r}": _one(r) for r in ("spaces", "line_breaks", "latex", "missing_images", "lists")
} | {
    "clean_pipeline": f"{_all()} SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars FROM cleaned",
    "cleaning_report": f"{_all()} SELECT doc_id, {_counts}, concat_ws('; ', {_log}) AS log, {_times(IMAGE_MISSING)} AS images_missing, {_times(FORMULA_IMAGE)} AS formulas_preserved, {_issues} AS ocr_issues FROM cleaned",
}
