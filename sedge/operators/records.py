"""Joins and fills over records: previews, uploads, search hits, tables put back, images beside tables, prompts, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sedge.operators import lines as L

#: Kinds of files in the order in which an upload is looked for, and the length up to which a preview is looked up (fixed values).
LOOKED_FOR, PREVIEW = ("pdf", "md", "txt"), 2000
#: Defaults of a paragraph style (fixed values).
DEFAULTS = {"line_spacing": 1.5, "line_spacing_rule": "multiple", "space_before_pt": 0.0, "space_after_pt": 0.0, "alignment": "left", "first_line_indent_chars": 0.0, "left_indent_cm": 0.0, "right_indent_cm": 0.0, "keep_together": False, "keep_with_next": False, "widow_control": True}
#: What stands for a context without results (fixed value).
NO_CONTEXT = "无 RAG 检索结果，请使用国标默认值。"


def append_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; repeated ones stay."""
    return old.unionByName(new)


def resolve_first_existing(uploads: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each upload (id, stem) with the first kind of file that exists for its stem; null: none, the upload is skipped."""
    rank = F.array_position(F.array(*map(F.lit, LOOKED_FOR)), F.col("ext"))
    best = inventory.where(F.col("ext").isin(*LOOKED_FOR)).groupBy("stem").agg(F.min_by("ext", rank).alias("ext"))
    return uploads.join(best.hint("merge"), "stem", "left").select("id", "ext")


def coalesce_preview(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """The preview, or the file's text where the preview is missing or short and a file exists."""
    met = tasks.join(files.hint("merge"), "id", "left")
    short = F.coalesce(F.length("preview"), F.lit(0)) <= PREVIEW
    return met.select("id", F.when(short & F.col("file_text").isNotNull(), F.col("file_text")).otherwise(F.col("preview")).alias("preview"))


def vector_hit_to_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the index of their chunk: by text, else by source and number; of several the last. Others are left out.

    Both sides are reduced to a row a key before they meet, so repeated texts add nothing to the join.
    """
    by_text = chunks.groupBy("text").agg(F.max("idx").alias("by_text"))
    by_place = chunks.where("chunk_index is not null").groupBy("source", "chunk_index").agg(F.max("idx").alias("by_place"))
    # The keys are compared null-safely, as a missing source is a value of its own.
    met = hits.join(by_text.hint("merge"), "text", "left").alias("h").join(by_place.hint("merge").alias("p"), F.expr("h.source <=> p.source and h.chunk_index = p.chunk_index"), "left")
    return met.select("h.hit", F.coalesce("by_text", "by_place").alias("idx")).where("idx is not null")


def restore_tables(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Placeholders (doc_id, n, placeholder, table_html) put back in order; how many were found and how many were not.

    A document's tables meet in one row, as its text does.
    """
    side = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "placeholder", "table_html"))).alias("kept"))
    start = F.struct(F.col("text").alias("text"), F.lit(0).alias("restored"))
    put = lambda a, x: F.struct(F.replace(a["text"], x["placeholder"], x["table_html"]).alias("text"), (a["restored"] + F.contains(a["text"], x["placeholder"]).cast("int")).alias("restored"))
    met = docs.join(side.hint("merge"), "doc_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<struct<n:int,placeholder:string,table_html:string>>")))
    done = met.withColumn("_d", F.aggregate("kept", start, put))
    return done.select("doc_id", F.col("_d.text").alias("text"), F.col("_d.restored").alias("restored"), (F.size("kept") - F.col("_d.restored")).alias("missing"))


def attach_table_images(text: Column, images: Column) -> Column:
    """The n-th image before the n-th table; what is left over on either side changes nothing."""
    parts = F.split(F.concat(F.lit("\x01"), text), r"(?i)(?=<table[\s>])", -1)
    put = lambda part, k: F.when((k > 0) & (k <= F.size(images)), F.concat(F.lit("![表格图片]("), F.get(images, k - 1), F.lit(")\n\n"), part)).otherwise(part)
    return F.substring(F.array_join(F.transform(parts, put), ""), 2, 1 << 30)


def assemble_prompt(template: Column, values: dict[str, Column], results: Column) -> Column:
    """Names in braces replaced one after another; the context is made of the first five results."""
    context = F.when(F.size(results) > 0, F.array_join(F.slice(results, 1, 5), "\n\n")).otherwise(F.lit(NO_CONTEXT))
    for name, value in (values | {"rag_context": context}).items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def apply_style_defaults(styles: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Missing values of a style filled; fields that are no columns are added, other columns stay."""
    given = DEFAULTS if defaults is None else defaults
    return styles.withColumns({k: F.coalesce(k, F.lit(v)) if k in styles.columns else F.lit(v) for k, v in given.items()})


def load_sections(rows: DataFrame) -> DataFrame:
    """Sections with a text: heading, or '(引言)' before the first; numbers are given before empty ones go."""
    text = F.col("line")
    head = text.rlike("^#{1,3} +[^ ]")
    cut = rows.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(L.by_doc().rowsBetween(W.unboundedPreceding, 0)))
    # A text before the first heading is a section of its own only if it is there.
    cut = cut.withColumn("led", F.max(~F.col("head") & (F.col("section") == 0)).over(W.partitionBy("doc_id")))
    body = F.expr("listagg(case when not head then line end, '\n') within group (order by pos)")
    made = cut.groupBy("doc_id", "section", "led").agg(F.max(F.when(F.col("head"), F.regexp_replace("line", "^#+ +", ""))).alias("title"), body.alias("text"))
    made = made.withColumn("text", L.stripped(F.coalesce("text", F.lit("")))).where("text <> ''")
    return made.select("doc_id", (F.col("section") - F.when(F.col("led"), 0).otherwise(1)).cast("long").alias("section_index"), F.coalesce("title", F.lit("(引言)")).alias("section_title"), "text")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _append(s, d):
    t = _docs(s, d).select("doc_id", "source")
    return append_chunks(t, t.where("doc_id % 2 = 0")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _resolve(s, d):
    return _resolve_of(s, d, "true")


def _resolve_of(s, d, which):
    files = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("stem"), F.expr("case event_type when 'view' then 'txt' when 'click' then 'md' when 'purchase' then 'pdf' else 'docx' end").alias("ext"))
    return resolve_first_existing(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("stem")), files.where(which))


def _preview(s, d):
    t = _docs(s, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("preview"))
    files = _docs(s, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("file "), "text").alias("file_text"))
    return coalesce_preview(t, files).select("id", F.md5("preview").alias("md5"))


def _hits(s, d):
    place = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 50)
    chunks = _docs(s, d).select(F.col("doc_id").alias("idx"), "text", "source", place.alias("chunk_index"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return vector_hit_to_chunk(_docs(s, d).select(F.col("doc_id").alias("hit"), text.alias("text"), "source", place.alias("chunk_index")), chunks)


def _restore(s, d):
    docs = _docs(s, d).select("doc_id", F.concat("text", F.lit(" {T0} and {T1}")).alias("text"))
    kept = _docs(s, d).where("doc_id % 3 > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("n"))
    kept = kept.select("doc_id", "n", F.format_string("{T%d}", "n").alias("placeholder"), F.format_string("<table>%d</table>", "n").alias("table_html"))
    return restore_tables(docs, kept).select("doc_id", "restored", "missing", F.md5("text").alias("md5"))


def _attach(s, d):
    text = F.concat(F.lit("<table>1</table>"), "text", F.lit("<TABLE x>2</TABLE><tables>"))
    images = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda k: F.concat(F.lit("i"), k.cast("string")))
    return _docs(s, d).select("doc_id", F.md5(attach_table_images(text, F.slice(images, 2, 9))).alias("md5"))


def _prompt(s, d):
    found = s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("found"))
    kind = F.when(F.col("id") % 2 == 0, F.lit("{rag_context}")).otherwise("note")
    return found.select("id", assemble_prompt(F.lit("A {document_type}: {rag_context}."), {"document_type": kind}, F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("found"))).alias("prompt"))


def _defaults(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    given = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 10).alias("line_spacing"), F.when(F.col("p_size") % 3 == 0, "center").alias("alignment"))
    return apply_style_defaults(given).select("p_partkey", "line_spacing", "alignment", "line_spacing_rule", "widow_control")


QUERIES = {
    "append_chunks": _append, "resolve_first_existing": _resolve, "resolve_first_existing_whole": lambda s, d: _resolve_of(s, d, "true"), "coalesce_preview": _preview, "vector_hit_to_chunk": _hits, "restore_tables": _restore,
    "attach_table_images": _attach, "assemble_prompt_lines": _prompt, "apply_flat_defaults": _defaults,
    "load_sections": lambda s, d: load_sections(L.noisy_lines(s, d)).select("doc_id", "section_index", "section_title", F.md5("text").alias("md5")),
}

_CH = "c AS (SELECT doc_id, text, source, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 50 END AS k FROM documents), t AS (SELECT text, max(doc_id) AS i FROM c GROUP BY 1), p AS (SELECT source, k, max(doc_id) AS j FROM c WHERE k IS NOT NULL GROUP BY ALL)"
ORACLES = {
    "append_chunks": "SELECT source, count(*) + count(*) FILTER (doc_id % 2 = 0) AS n FROM documents GROUP BY source",
    "resolve_first_existing": "WITH f AS (SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END) AS r FROM events GROUP BY 1) SELECT p_partkey AS id, CASE r WHEN 1 THEN 'pdf' WHEN 2 THEN 'md' WHEN 3 THEN 'txt' END AS ext FROM part LEFT JOIN f ON user_id = p_partkey",
    "resolve_first_existing_whole": "WITH f AS (SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END) AS r FROM events GROUP BY 1) SELECT p_partkey AS id, CASE r WHEN 1 THEN 'pdf' WHEN 2 THEN 'md' WHEN 3 THEN 'txt' END AS ext FROM part LEFT JOIN f ON user_id = p_partkey",
    "coalesce_preview": "SELECT doc_id AS id, md5(CASE WHEN doc_id % 2 = 0 AND (doc_id % 5 = 0 OR coalesce(length(text), 0) <= 2000) THEN 'file ' || text WHEN doc_id % 5 <> 0 THEN text END) AS md5 FROM documents",
    "vector_hit_to_chunk": f"WITH {_CH} SELECT doc_id AS hit, coalesce(i, j) AS idx FROM c LEFT JOIN t ON t.text = CASE WHEN doc_id % 3 = 0 THEN c.text || '?' ELSE c.text END LEFT JOIN p ON p.source IS NOT DISTINCT FROM c.source AND p.k = c.k WHERE coalesce(i, j) IS NOT NULL",
    "restore_tables": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 ELSE 2 END AS restored, CASE doc_id % 3 WHEN 2 THEN 1 ELSE 0 END AS missing, md5(text || CASE WHEN doc_id % 3 = 0 THEN ' {T0} and {T1}' ELSE ' <table>0</table> and <table>1</table>' END) AS md5 FROM documents",
    "attach_table_images": "SELECT doc_id, md5(CASE WHEN doc_id % 3 > 0 THEN '![表格图片](i1)' || chr(10) || chr(10) ELSE '' END || '<table>1</table>' || text || CASE WHEN doc_id % 3 = 2 THEN '![表格图片](i2)' || chr(10) || chr(10) ELSE '' END || '<TABLE x>2</TABLE><tables>') AS md5 FROM documents",
    "assemble_prompt_lines": f"WITH f AS (SELECT o_custkey AS id, list_sort(list(CAST(o_orderkey AS VARCHAR)))[1:5] AS x FROM orders GROUP BY 1), c AS (SELECT id, CASE WHEN id % 7 = 0 THEN '{NO_CONTEXT}' ELSE array_to_string(x, chr(10) || chr(10)) END AS c FROM f) SELECT id, 'A ' || CASE WHEN id % 2 = 0 THEN c ELSE 'note' END || ': ' || c || '.' AS prompt FROM c",
    "apply_flat_defaults": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 10 ELSE 1.5 END AS line_spacing, CASE WHEN p_size % 3 = 0 THEN 'center' ELSE 'left' END AS alignment, 'multiple' AS line_spacing_rule, true AS widow_control FROM part",
    "load_sections": rf"WITH {L.NOISY_SQL}, h AS (SELECT *, regexp_matches(line, '^#{{1,3}} +[^ ]') AS head FROM lines), c AS (SELECT *, sum(CAST(head AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h), g AS (SELECT doc_id, section, max(regexp_replace(line, '^#+ +', '')) FILTER (head) AS title, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS text, dense_rank() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS section_index FROM c GROUP BY doc_id, section) SELECT doc_id, CAST(section_index AS BIGINT) AS section_index, coalesce(title, '(引言)') AS section_title, md5(text) AS md5 FROM g WHERE text <> ''",
}
