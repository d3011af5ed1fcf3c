"""Line operators: cleaning rules that need one line only, sections, contents removal, merges and line roles.

All of them work on one narrow table of lines (doc_id, pos, line) and share one window by document and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Full-width characters and what replaces them (fixed values).
FULL = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF08, 0xFF09])
HALF = "".join(chr(c) for c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x28, 0x29])
#: The same as ranges: Java tries the parts of a class one after another on every character.
FULL_CLASS = r"[\x{FF08}\x{FF09}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]"

#: Role patterns in the order they are tried (fixed values). \s stands for Unicode white space.
ROLES = (
    ("appendix_title", r"^附录\s*[A-Z]"),
    ("appendix_clause_5", r"^[A-Z]\.\d+\.\d+\.\d+\.\d+\s+\S"),
    ("appendix_clause_4", r"^[A-Z]\.\d+\.\d+\.\d+\s+\S"),
    ("appendix_clause_3", r"^[A-Z]\.\d+\.\d+\s+\S"),
    ("appendix_clause_2", r"^[A-Z]\.\d+\s+\S"),
    ("table_caption", r"^表\s*[A-Z]?\.?\d+"),
    ("figure_caption", r"^图\s*\d+"),
    ("method_heading", r"^第[一二三四五六七八九十百]+法\s"),
    ("cover_marker", r"中华人民共和国国家标准"),
    ("preface", r"^(前言|引言|参考文献)$|^第[一二三四五六七八九十]+\s*(法|部分|章|节)"),
    ("heading_5", r"^\d+\.\d+\.\d+\.\d+\.\d+\s+\S"),
    ("heading_4", r"^\d+\.\d+\.\d+\.\d+\s+\S"),
    ("heading_3", r"^\d+\.\d+\.\d+\s+\S"),
    ("heading_2", r"^\d+\.\d+\s+\S"),
    ("heading_1", r"^\d+\s+\S"),
)

#: Contents lines, bare numbers that a heading was cut from, and what may not follow them (fixed values).
CONTENTS = ("目  次", "目次", "目  录", "目录")
MARKS, CHAPTER_ONE = r"^#+\s*", r"^1\s{2,}\S"
BARE_APPENDIX, AFTER_APPENDIX = r"^附录\s*[A-Z]$", r"^附录|^\d+\s+"
BARE_NUMBER, AFTER_NUMBER = r"^(\d+(\.\d+)*|[A-Z]\.\d+(\.\d+)*)$", r"^(\d+(\.\d+)*|[A-Z]\.\d+)|^附录"
#: Lines planted into the test texts.
PLANTED = ((2, "目次"), (5, "前言"), (8, "附录 A"), (9, "培养基"), (11, "3.1.1"), (12, "术语"), (14, "A.1"), (15, "范围"), (17, "附录 B"), (18, "3D 打印"), (20, "  3.2"), (21, "# 标题"), (22, "附录 C"), (23, "4 方法"), (24, "## 目  次"), (27, "## 前 言"))


def by_doc():
    """The one window of all line operators: a document's lines in order."""
    return W.partitionBy("doc_id").orderBy("pos")


def noisy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines with the faults that the rules repair, a blank line after every fourth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    p, line = F.col("p"), F.col("line")
    digits = "abc0123456789"
    line = F.when(p % 5 == 1, F.replace(line, F.lit(" "), F.lit("  "))).otherwise(line)
    line = F.when(p % 5 == 3, F.translate(line, digits, "".join(chr(ord(c) + 0xFEE0) for c in digits))).otherwise(line)
    line = F.when(p % 13 == 4, F.concat(line, F.lit("�"))).otherwise(line)
    line = F.when(p % 7 == 0, F.concat(F.lit("##"), line)).when(p % 7 == 3, F.concat(F.lit("## "), line)).when(p % 6 == 4, F.concat(F.lit("-"), line)).otherwise(line)
    for at, text in PLANTED:
        line = F.when(p == at, text).otherwise(line)
    place = p + F.floor(p / 4).cast("int")
    both = F.explode(F.when(p % 4 == 3, F.array(F.struct(place.alias("pos"), line.alias("line")), F.struct((place + 1).alias("pos"), F.lit("").alias("line")))).otherwise(F.array(F.struct(place.alias("pos"), line.alias("line")))))
    return raw.select("doc_id", both.alias("x")).select("doc_id", "x.pos", "x.line")


_fold = lambda cs: "".join(chr(ord(c) + 0xFEE0) for c in cs)
NOISY_SQL = f"""
raw AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p, unnest(string_split(text, chr(10))) AS line FROM documents),
n1 AS (SELECT doc_id, p, CASE WHEN p % 5 = 1 THEN replace(line, ' ', '  ') WHEN p % 5 = 3 THEN translate(line, 'abc0123456789', '{_fold("abc0123456789")}') ELSE line END AS line FROM raw),
n2 AS (SELECT doc_id, p, CASE WHEN p % 13 = 4 THEN line || chr(65533) ELSE line END AS line FROM n1),
n3 AS (SELECT doc_id, p, CASE WHEN p % 7 = 0 THEN '##' || line WHEN p % 7 = 3 THEN '## ' || line WHEN p % 6 = 4 THEN '-' || line ELSE line END AS line FROM n2),
n4 AS (SELECT doc_id, p, CASE p {' '.join(f"WHEN {at} THEN '{text}'" for at, text in PLANTED)} ELSE line END AS line FROM n3),
lines AS (SELECT doc_id, p + p // 4 AS pos, line FROM n4 UNION ALL SELECT doc_id, p + p // 4 + 1, '' FROM n4 WHERE p % 4 = 3)"""


def stripped(line: Column) -> Column:
    """Without Unicode white space at its ends."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def clean_fullwidth(line: Column) -> tuple[Column, Column]:
    return F.translate(line, FULL, HALF), F.regexp_count(line, F.lit(FULL_CLASS))


def clean_garbled(line: Column) -> tuple[Column, Column]:
    bad = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
    return F.regexp_replace(line, bad, ""), F.regexp_count(line, F.lit(bad))


def clean_headings(line: Column) -> tuple[Column, Column]:
    """One space between the marks and the text; counted where there was none."""
    marks, rest = F.regexp_extract(line, "^(#{1,6})(.*)$", 1), F.regexp_extract(line, "^(#{1,6})(.*)$", 2)
    return F.when(marks != "", F.concat(marks, F.lit(" "), stripped(rest))).otherwise(line), ((marks != "") & ~rest.startswith(" ")).cast("int")


RULES = {"fullwidth": clean_fullwidth, "headings": clean_headings, "garbled": clean_garbled}


def section_boundaries(lines: DataFrame, deepest: int = 3) -> DataFrame:
    """Sections by headings of up to `deepest` marks: heading, first line, lines and characters; text before the first is section 0."""
    head = F.col("line").rlike(f"^#{{1,{deepest}}} +[^ ]")
    cut = lines.withColumn("head", head).withColumn("section", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(by_doc().rowsBetween(W.unboundedPreceding, 0)))
    return cut.groupBy("doc_id", "section").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.regexp_replace("line", "^#+ +", ""))), F.lit("")).alias("heading"),
        F.min("pos").alias("first_pos"), F.count_if(~F.col("head")).alias("n_lines"), F.coalesce(F.sum(F.when(~F.col("head"), F.length("line"))), F.lit(0)).cast("long").alias("n_chars"),
    )


def contents_state(lines: DataFrame) -> DataFrame:
    """The lines with their state: toc in a contents list, end behind one, null before the first.

    A list runs from a contents line to a preface line or a first chapter, else to the end.
    """
    text = stripped(F.col("line"))
    bare = F.regexp_replace(text, "(?U)" + MARKS, "")
    mark = F.when(bare.isin(*CONTENTS), "toc").when((bare.startswith("前") & bare.contains("言")) | text.rlike("(?U)" + CHAPTER_ONE), "end")
    state = F.last(mark, ignorenulls=True).over(by_doc().rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("state", state)


def remove_toc(lines: DataFrame) -> DataFrame:
    """Lines outside contents lists."""
    return contents_state(lines).where(F.coalesce(F.col("state") != "toc", F.lit(True))).drop("state")


def split_headings(lines: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """Bare appendix letters and clause numbers that start a pair with the next line; pairs are taken greedily from the top.

    A line that begins with one of `stops` ends no pair.

    The lines with starts, taken (the line before starts), then (the next line, stripped) and new, the line after joining.
    """
    text = stripped(F.col("line"))
    after = F.lead(text).over(by_doc())
    fits = lambda t, p: t.rlike("(?U)" + p)
    opens = (after != "") & ((fits(text, BARE_APPENDIX) & ~fits(after, AFTER_APPENDIX)) | (fits(text, BARE_NUMBER) & ~fits(after, AFTER_NUMBER)))
    for stop in stops:
        opens = opens & ~after.startswith(stop)
    flagged = lines.withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("run", F.sum(F.when(~F.col("opens"), 1).otherwise(0)).over(by_doc().rowsBetween(W.unboundedPreceding, -1)))
    # Within a run of lines that could each open a pair, every other one does: what a walk from the top would choose.
    in_run = F.row_number().over(W.partitionBy("doc_id", F.coalesce("run", F.lit(0))).orderBy("pos"))
    paired = flagged.withColumn("starts", F.col("opens") & (in_run % 2 == 1))
    paired = paired.withColumn("taken", F.lag("starts", 1, False).over(by_doc())).withColumn("then", after)
    joined = F.concat(F.regexp_extract("line", r"(?U)^(\s*)", 1), text, F.lit("  "), F.col("then"))
    return paired.withColumn("new", F.when(F.col("starts"), joined).otherwise(F.col("line")))


def merge_split_headings(lines: DataFrame) -> DataFrame:
    """A bare appendix letter or clause number joined to the next line by two spaces, its indent kept."""
    return split_headings(lines).where("not taken").select("doc_id", "pos", F.col("new").alias("line"))


def line_role(line: Column) -> Column:
    """The first role whose pattern fits the stripped line; null for body text."""
    text = stripped(line)
    return F.coalesce(*(F.when(text.rlike("(?U)" + p), role) for role, p in ROLES))


def role_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Roles by rules given as data (profile, priority, pattern, role): the lowest priority that fits wins; none: null.

    rules is a small table of patterns (1,000 at most, checked) sent to every task; a priority may occur once a profile.
    """
    if rules.limit(1001).count() > 1000 or rules.groupBy("profile", "priority").count().where("count > 1").count():
        raise ValueError("at most 1000 rules, a priority once a profile")
    met = lines.join(F.broadcast(rules), (lines["profile"] == rules["profile"]) & F.expr("line rlike pattern"), "left").select(lines["*"], rules["priority"], rules["role"])
    return met.groupBy("doc_id", "pos").agg(F.min_by("role", "priority").alias("role"))


def role_histogram(lines: DataFrame) -> DataFrame:
    names = [r for r, _ in ROLES]
    found = lines.withColumn("role", line_role(F.col("line")))
    return found.groupBy("doc_id").agg(*(F.count_if(F.col("role") == n).alias(n) for n in names), F.count(F.lit(1)).alias("total"))


def _rule(name):
    def run(spark, sf_dir):
        lines = noisy_lines(spark, sf_dir)
        new, count = RULES[name](F.col("line"))
        return lines.select("doc_id", "pos", new.alias("line"), count.cast("long").alias("n"))

    return run


def _rules_as_data(spark, sf_dir):
    rules = spark.createDataFrame([("std", k, "(?U)" + p, r) for k, (r, p) in enumerate(ROLES)], "profile string, priority int, pattern string, role string")
    return role_rules(noisy_lines(spark, sf_dir).withColumn("profile", F.lit("std")).withColumn("line", stripped(F.col("line"))), rules)


QUERIES = {f"clean_{r}": _rule(r) for r in RULES} | {
    "section_boundaries": lambda s, d: section_boundaries(noisy_lines(s, d)),
    "remove_toc": lambda s, d: remove_toc(noisy_lines(s, d)),
    "merge_split_headings": lambda s, d: merge_split_headings(noisy_lines(s, d)),
    "line_role": lambda s, d: noisy_lines(s, d).select("doc_id", "pos", line_role(F.col("line")).alias("role")),
    "role_rules": _rules_as_data,
    "role_histogram": lambda s, d: role_histogram(noisy_lines(s, d)),
}

_BAD = "[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
_SQL = {
    "fullwidth": (f"translate(line, '{FULL}', '{HALF}')", f"length(line) - length(regexp_replace(line, '[{FULL}]', '', 'g'))"),
    "headings": ("CASE WHEN line LIKE '#%' THEN regexp_extract(line, '^#{1,6}') || ' ' || trim(regexp_replace(line, '^#{1,6}', '')) ELSE line END", "CAST(line LIKE '#%' AND regexp_replace(line, '^#{1,6}', '') NOT LIKE ' %' AS BIGINT)"),
    "garbled": (f"regexp_replace(line, '{_BAD}', '', 'g')", f"length(line) - length(regexp_replace(line, '{_BAD}', '', 'g'))"),
}
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(trim(line), '{p}') THEN '{r}'" for r, p in ROLES) + " END"

ORACLES = {f"clean_{r}": f"WITH {NOISY_SQL} SELECT doc_id, pos, {line} AS line, {n} AS n FROM lines" for r, (line, n) in _SQL.items()} | {
    "section_boundaries": f"WITH {NOISY_SQL}, h AS (SELECT *, regexp_matches(line, '^#{{1,3}} +[^ ]') AS head FROM lines), c AS (SELECT *, sum(CAST(head AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h) SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN head THEN regexp_replace(line, '^#+ +', '') END), '') AS heading, min(pos) AS first_pos, count(*) FILTER (NOT head) AS n_lines, CAST(coalesce(sum(length(line)) FILTER (NOT head), 0) AS BIGINT) AS n_chars FROM c GROUP BY ALL",
    "remove_toc": f"WITH {NOISY_SQL}, m AS (SELECT *, CASE WHEN regexp_replace(trim(line), '^#+\\s*', '') IN ('目次', '目录', '目  次', '目  录') THEN 'toc' WHEN regexp_matches(regexp_replace(trim(line), '^#+\\s*', ''), '^前.*言') OR regexp_matches(trim(line), '^1\\s{{2,}}\\S') THEN 'end' END AS mark FROM lines), s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM m) SELECT doc_id, pos, line FROM s WHERE coalesce(state <> 'toc', true)",
    "merge_split_headings": f"WITH RECURSIVE {NOISY_SQL}, o AS MATERIALIZED (SELECT doc_id, pos, line, row_number() OVER w AS k, lead(trim(line)) OVER w AS nxt, coalesce(lead(trim(line)) OVER w <> '' AND NOT starts_with(lead(trim(line)) OVER w, '附录') AND CASE WHEN regexp_matches(trim(line), '^附录\\s*[A-Z]$') THEN NOT regexp_matches(lead(trim(line)) OVER w, '^\\d+\\s') WHEN regexp_matches(trim(line), '^([A-Z]\\.)?\\d+(\\.\\d+)*$') THEN NOT regexp_matches(lead(trim(line)) OVER w, '^([A-Z]\\.)?\\d') ELSE false END, false) AS opens FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT doc_id, k, opens AS starts, false AS taken FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.k, o.opens AND NOT r.starts, r.starts FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1) SELECT o.doc_id, pos, CASE WHEN starts THEN regexp_extract(line, '^\\s*') || trim(line) || '  ' || nxt ELSE line END AS line FROM o JOIN r USING (doc_id, k) WHERE NOT taken",
    "line_role": f"WITH {NOISY_SQL} SELECT doc_id, pos, {_ROLE} AS role FROM lines",
    "role_rules": f"WITH {NOISY_SQL} SELECT doc_id, pos, {_ROLE} AS role FROM lines",
    "role_histogram": f"WITH {NOISY_SQL}, r AS (SELECT doc_id, {_ROLE} AS role FROM lines) SELECT doc_id, {', '.join(f'''count(*) FILTER (role = '{r}') AS {r}''' for r, _ in ROLES)}, count(*) AS total FROM r GROUP BY doc_id",
}
