"""Normalizing of lines with a log of every change: date pairs, split headings, contents lists, heading spaces.

All rules are windows over one document's lines in order, so the lines move once. What a rule notes travels with the line
that it leaves; lines of contents lists are flagged, not dropped, until the end, so their notes stay too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sedge.operators import cleaning, lines as L, paragraphs as P

#: Texts of the log (fixed values).
MERGED_DATES, MERGED_HEADING = "合并日期行: '{}' + '{}' → '{}'", "合并拆分标题: '{}' + '{}' → '{}'"
REMOVED_START, REMOVED_LINES, FIXED_SPACES = "删除 TOC 起始行: '{}'", "删除 TOC 区域共 {} 行", "修正标题空格: '{}' → '{}'"
DATES, HEADINGS, CONTENTS, SPACES = 1, 2, 3, 4
#: What ends no split heading of a Word file, and the texts of its log (fixed values).
WORD_STOPS = ("前言", "参考文献")
WORD_DATES, WORD_CONTENTS, WORD_HEADINGS, WORD_SPACES = "合并日期行: '{}'", "删除 TOC: {} 个段落 (P[{}]-P[{}])", "合并拆分标题: {} 处", "修正标题双空格: {} 处"


def _said(text: str, *values: Column) -> Column:
    return F.format_string(text.replace("{}", "%s"), *values)


def _note(when: Column, rule: int, entry: Column, part: int = 0) -> Column:
    note = F.struct(F.lit(rule).alias("rule"), F.col("pos").cast("long").alias("pos"), F.lit(part).alias("part"), entry.alias("entry"))
    return F.when(when, F.array(note)).otherwise(F.array().cast("array<struct<rule:int,pos:bigint,part:int,entry:string>>"))


def normalize_steps(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, line, gone, log): every line that is left after joining, whether it lies in a contents list, and notes.

    rows: (doc_id, pos, line), a place once a document. log holds (rule, pos, part, entry); pos is the place of the line
    that was changed, of a pair's first line, and the count of removed lines is part 1 of the last one. A null line stays null and is never joined or changed; other columns are left out.
    """
    line = L.stripped(F.col("line"))
    dated = P.date_pairs(rows.select("doc_id", "pos", "line")).where("not taken")
    dated = dated.select("doc_id", "pos", F.col("new").alias("line"), _note(F.col("starts"), DATES, _said(MERGED_DATES, line, F.col("then"), F.col("both"))).alias("log"))
    # A pair of dates may itself be joined to a number before it: its notes go to that line.
    paired = L.split_headings(dated)
    joined = paired.withColumn("joined_log", F.when(F.col("starts"), F.lead("log").over(L.by_doc())).otherwise(F.slice("log", 1, 0))).where("not taken")
    note = _note(F.col("starts"), HEADINGS, _said(MERGED_HEADING, line, F.col("then"), L.stripped(F.col("new"))))
    joined = joined.select("doc_id", "pos", F.col("new").alias("line"), F.concat("log", "joined_log", note).alias("log"))
    doc = W.partitionBy("doc_id")
    gone = F.coalesce(F.col("state") == "toc", F.lit(False))
    listed = L.contents_state(joined).withColumn("gone", gone)
    listed = listed.withColumn("first", F.col("gone") & ~F.lag("gone", 1, False).over(L.by_doc()))
    listed = listed.withColumn("n_gone", F.count_if("gone").over(doc)).withColumn("last_gone", F.max(F.when(F.col("gone"), F.col("pos"))).over(doc))
    total = _note(F.coalesce(F.col("pos") == F.col("last_gone"), F.lit(False)), CONTENTS, _said(REMOVED_LINES, F.col("n_gone")), 1)
    log = F.concat("log", _note(F.col("first"), CONTENTS, _said(REMOVED_START, line)), total)
    new, wrong = P.fix_heading_spaces(F.col("line"))
    wrong = ~F.col("gone") & F.coalesce(wrong == 1, F.lit(False))
    fixed = _note(wrong, SPACES, _said(FIXED_SPACES, line, L.stripped(new)))
    return listed.select("doc_id", "pos", F.when(wrong, new).otherwise(F.col("line")).alias("line"), "gone", F.concat(log, fixed).alias("log"))


def changes_of(steps: DataFrame) -> DataFrame:
    """(doc_id, rule, pos, part, entry): the log of every document, a row a change; its order is that of rule, pos, part."""
    return steps.select("doc_id", F.explode("log").alias("x")).select("doc_id", "x.*")


def logs_of(steps: DataFrame) -> DataFrame:
    """(doc_id, log): one document's entries in order; documents without a change have an empty log."""
    whole = steps.groupBy("doc_id").agg(F.flatten(F.collect_list(F.when(F.size("log") > 0, F.col("log")))).alias("log"))
    return whole.select("doc_id", F.transform(F.array_sort("log"), lambda x: x["entry"]).alias("log"))


def normalize_word_steps(rows: DataFrame) -> DataFrame:
    """Paragraphs of Word files, normalized: (doc_id, pos, line, dates, first, end, joined, fixed).

    Order and rules are those of Word files: the first pair of dates only, then a contents list, only if a preface follows
    it, then split headings, then two spaces behind a number, whatever the text behind it. A changed paragraph loses the
    white space at its ends. dates (the joined pair) and first and end (places of the contents list among the paragraphs
    behind the first rule, end exclusive) are the same in all rows of a document, null without such a change. A null line
    stays null and is never changed.
    """
    doc, text = W.partitionBy("doc_id"), L.stripped(F.col("line"))
    without = lambda t, mark: L.stripped(F.replace(t, F.lit(mark), F.lit("")))
    then = L.stripped(F.lead("line").over(L.by_doc()))
    pair = F.when(text.endswith("发布") & then.endswith("实施"), F.concat(without(text, "发布"), F.lit("发布 "), without(then, "实施"), F.lit("实施")))
    out = rows.select("doc_id", "pos", "line").withColumn("pair", pair)
    out = out.withColumn("starts", F.coalesce(F.col("pos") == F.min(F.when(F.col("pair").isNotNull(), F.col("pos"))).over(doc), F.lit(False)))
    out = out.withColumn("taken", F.lag("starts", 1, False).over(L.by_doc())).withColumn("dates", F.max(F.when(F.col("starts"), F.col("pair"))).over(doc))
    out = out.where("not taken").select("doc_id", "pos", F.when(F.col("starts"), F.col("pair")).otherwise(F.col("line")).alias("line"), "dates")
    out = out.withColumn("i", F.row_number().over(L.by_doc()) - 1)
    out = out.withColumn("first", F.min(F.when(text.isin(*L.CONTENTS), F.col("i"))).over(doc))
    preface = text.startswith("前") & text.contains("言")
    out = out.withColumn("end", F.min(F.when((F.col("i") > F.col("first")) & preface, F.col("i"))).over(doc))
    out = out.withColumn("first", F.when(F.col("end").isNotNull(), F.col("first")))
    out = out.where("not coalesce(i >= first and i < end, false)")
    out = L.split_headings(out, WORD_STOPS).where("not taken")
    out = out.withColumn("line", F.when(F.col("starts"), L.stripped(F.col("new"))).otherwise(F.col("line"))).withColumnRenamed("starts", "joined")
    parts = r"(?dU)^(\d+(?:\.\d+)*)(\s+)(.*)$"
    wrong = F.coalesce(text.rlike(parts) & (F.regexp_extract(text, parts, 2) != "  "), F.lit(False))
    fixed = F.concat(F.regexp_extract(text, parts, 1), F.lit("  "), F.regexp_extract(text, parts, 3))
    return out.select("doc_id", "pos", F.when(wrong, fixed).otherwise(F.col("line")).alias("line"), "dates", "first", "end", "joined", wrong.alias("fixed"))


def word_logs(steps: DataFrame) -> DataFrame:
    """(doc_id, log) of normalize_word_steps: at most one entry for each rule; documents without paragraphs have no row."""
    one = steps.groupBy("doc_id").agg(F.max("dates").alias("dates"), F.max("first").alias("first"), F.max("end").alias("end"), F.count_if("joined").alias("joined"), F.count_if("fixed").alias("fixed"))
    entries = (
        F.when(F.col("dates").isNotNull(), _said(WORD_DATES, F.col("dates"))),
        F.when(F.col("end").isNotNull(), _said(WORD_CONTENTS, F.col("end") - F.col("first"), F.col("first"), F.col("end") - 1)),
        F.when(F.col("joined") > 0, _said(WORD_HEADINGS, F.col("joined"))),
        F.when(F.col("fixed") > 0, _said(WORD_SPACES, F.col("fixed"))),
    )
    return one.select("doc_id", F.array_compact(F.array(*entries)).alias("log"))


def merge_change_logs(*logs: Column) -> Column:
    """The entries of several logs in one, in the order given; a null log has none."""
    return F.concat(*(F.coalesce(log, F.array().cast("array<string>")) for log in logs))


def _document_logs(s, d):
    cleaned = cleaning.clean_documents(cleaning.noisy_texts(s, d), cleaning.inventory(s)).select("doc_id", "log")
    noted = logs_of(normalize_steps(P._dated(s, d))).withColumnRenamed("log", "noted")
    both = cleaned.join(noted.hint("merge"), "doc_id", "left")
    log = merge_change_logs(F.col("log"), F.col("noted"))
    return both.select("doc_id", F.size(log).cast("long").alias("n"), F.array_join(log, "\n").alias("log"))


#: Paragraphs put into two of three documents, by place.
_WORD = {12: "目次", 16: " 前言", 21: "附录 D", 22: "参考文献", 24: "7 rest", 30: "附录 E", 31: "范围 "}


def _worded(s, d):
    return P._dated(s, d).withColumn("line", P._with(_WORD, F.when(F.col("doc_id") % 3 != 0, F.col("pos"))))


QUERIES = {
    "normalize_word": lambda s, d: normalize_word_steps(_worded(s, d)).select("doc_id", "pos", "line"),
    "normalize_word_log": lambda s, d: word_logs(normalize_word_steps(_worded(s, d))).withColumn("log", F.array_join("log", "\n")),
    "normalize_changes": lambda s, d: changes_of(normalize_steps(P._dated(s, d))),
    "normalize_changes_text": lambda s, d: normalize_steps(P._dated(s, d)).where("not gone").select("doc_id", "pos", "line"),
    "merge_change_logs": _document_logs,
}


def _said_sql(text: str, *values: str) -> str:
    parts = [cleaning._quoted(part) for part in text.split("{}")]
    return " || ".join(x for pair in zip(parts, (*values, "''"), strict=True) for x in pair)


_CHANGES = f"""{P._MERGED}, {P._SPLIT},
marked AS (SELECT *, regexp_replace(trim(line), '^#+\\s*', '') AS bare FROM heads),
listed AS (SELECT *, last_value(CASE WHEN bare IN ('目次', '目录', '目  次', '目  录') THEN 'toc' WHEN regexp_matches(bare, '^前.*言') OR regexp_matches(trim(line), '^1\\s{{2,}}\\S') THEN 'end' END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM marked),
stated AS (SELECT *, coalesce(state = 'toc', false) AS gone, coalesce(lag(state) OVER (PARTITION BY doc_id ORDER BY pos) = 'toc', false) AS before FROM listed),
kept AS (SELECT doc_id, pos, line, {P._FIX} AS new, {P._WRONG} AS wrong FROM stated WHERE NOT gone),
noted AS (
  SELECT doc_id, 1 AS rule, pos, 0 AS j, {_said_sql(MERGED_DATES, "trim(line)", "trim(nxt)", "m")} AS entry FROM c WHERE (u OR v) AND NOT coalesce(taken, false)
  UNION ALL SELECT doc_id, 2, pos, 0, {_said_sql(MERGED_HEADING, "trim(line)", "nxt", "trim(line) || '  ' || nxt")} FROM o JOIN r USING (doc_id, k) WHERE starts AND NOT taken
  UNION ALL SELECT doc_id, 3, pos, 0, {_said_sql(REMOVED_START, "trim(line)")} FROM stated WHERE gone AND NOT before
  UNION ALL SELECT doc_id, 3, max(pos), 1, {_said_sql(REMOVED_LINES, "count(*)")} FROM stated WHERE gone GROUP BY doc_id
  UNION ALL SELECT doc_id, 4, pos, 0, {_said_sql(FIXED_SPACES, "trim(line)", "trim(new)")} FROM kept WHERE wrong)"""

_NUMBERED = r"^(\d+(\.\d+)*)(\s+)(.*)$"
_WORD_SQL = rf"""{P._DATED_SQL}, worded AS (SELECT doc_id, pos, {P._overlay(_WORD, "CASE WHEN doc_id % 3 <> 0 THEN pos END")} AS line FROM dated),
wa AS (SELECT *, trim(line) AS t, trim(lead(line) OVER (PARTITION BY doc_id ORDER BY pos)) AS nxt FROM worded),
wb AS (SELECT *, min(pos) FILTER (t LIKE '%发布' AND nxt LIKE '%实施') OVER (PARTITION BY doc_id) AS top FROM wa),
wc AS (SELECT *, CASE WHEN pos = top THEN trim(replace(t, '发布', '')) || '发布 ' || trim(replace(nxt, '实施', '')) || '实施' END AS pair, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = top AS taken FROM wb),
wd AS (SELECT doc_id, pos, coalesce(pair, line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM wc WHERE NOT coalesce(taken, false)),
we AS (SELECT *, min(i) FILTER (trim(line) IN ('目次', '目录', '目  次', '目  录')) OVER (PARTITION BY doc_id) AS f FROM wd),
wf AS (SELECT *, min(i) FILTER (i > f AND trim(line) LIKE '前%言%') OVER (PARTITION BY doc_id) AS e FROM we),
wg AS (SELECT doc_id, pos, line, trim(line) AS t FROM wf WHERE NOT coalesce(i >= f AND i < e, false)),
wh AS (SELECT *, row_number() OVER w AS k, lead(t) OVER w AS nxt FROM wg WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
wo AS MATERIALIZED (SELECT *, coalesce(nxt <> '' AND NOT regexp_matches(nxt, '^(附录|前言|参考文献)') AND CASE WHEN regexp_matches(t, '^附录\s*[A-Z]$') THEN NOT regexp_matches(nxt, '^\d+\s')
      WHEN regexp_matches(t, '^([A-Z]\.)?\d+(\.\d+)*$') THEN NOT regexp_matches(nxt, '^([A-Z]\.)?\d') ELSE false END, false) AS opens FROM wh),
wr AS (SELECT doc_id, k, opens AS starts, false AS taken FROM wo WHERE k = 1 UNION ALL SELECT wo.doc_id, wo.k, wo.opens AND NOT wr.starts, wr.starts FROM wr JOIN wo ON wo.doc_id = wr.doc_id AND wo.k = wr.k + 1),
ws AS (SELECT doc_id, pos, starts, CASE WHEN starts THEN t || '  ' || nxt ELSE line END AS line FROM wo JOIN wr USING (doc_id, k) WHERE NOT taken),
wx AS (SELECT *, coalesce(regexp_matches(trim(line), '{_NUMBERED}') AND regexp_extract(trim(line), '{_NUMBERED}', 3) <> '  ', false) AS fixed FROM ws)"""

ORACLES = {
    "normalize_word": f"WITH RECURSIVE {_WORD_SQL} SELECT doc_id, pos, CASE WHEN fixed THEN regexp_extract(trim(line), '{_NUMBERED}', 1) || '  ' || regexp_extract(trim(line), '{_NUMBERED}', 4) ELSE line END AS line FROM wx",
    "normalize_word_log": f"""WITH RECURSIVE {_WORD_SQL}, wn AS (SELECT doc_id, count(*) FILTER (starts) AS joined, count(*) FILTER (fixed) AS fixed FROM wx GROUP BY doc_id),
wp AS (SELECT doc_id, max(pair) AS pair FROM wc GROUP BY doc_id), wq AS (SELECT doc_id, max(f) AS f, max(e) AS e FROM wf GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), {_said_sql(WORD_DATES, "pair")}, {_said_sql(WORD_CONTENTS, "(e - f)", "f", "(e - 1)")},
  CASE WHEN joined > 0 THEN {_said_sql(WORD_HEADINGS, "joined")} END, CASE WHEN fixed > 0 THEN {_said_sql(WORD_SPACES, "fixed")} END) AS log FROM wn JOIN wp USING (doc_id) JOIN wq USING (doc_id)""",
    "normalize_changes": f"WITH RECURSIVE {_CHANGES} SELECT doc_id, rule, pos, j AS part, entry FROM noted",
    "normalize_changes_text": f"WITH RECURSIVE {_CHANGES} SELECT doc_id, pos, new AS line FROM kept",
    "merge_change_logs": f"""{cleaning._all().replace("WITH ", "WITH RECURSIVE ", 1)}, {_CHANGES},
entries AS (SELECT doc_id, 0 AS rule, k AS pos, 0 AS j, entry FROM (SELECT doc_id, unnest([{cleaning._log}]) AS entry, generate_subscripts([{cleaning._log}], 1) AS k FROM cleaned) WHERE entry IS NOT NULL
  UNION ALL SELECT * FROM noted)
SELECT doc_id, count(entry) AS n, coalesce(string_agg(entry, chr(10) ORDER BY rule, pos, j), '') AS log FROM texts LEFT JOIN entries USING (doc_id) GROUP BY doc_id""",
}
