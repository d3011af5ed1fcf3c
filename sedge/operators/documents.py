"""Document operators: titles, features, chunks with overlap, table cells, model replies, edits, defaults and checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from sedge.operators import batches, cleaning, lines, reports
from sedge.sources.corpus import sink_chunks
from sedge.workspace import Scratch, small_batches

#: Characters of a chunk and the share of them repeated in the next (fixed values).
CHUNK, OVERLAP = 700, 0.15
#: Headings that cut a text into chunks, and sentences with their end (fixed values).
HEADING, SENTENCE = r"^#{1,3}\s+.+$", r"[^。！？.!?]*[。！？.!?]|[^。！？.!?]+"


def extract_title(rows: DataFrame) -> DataFrame:
    """The text of each document's first line that starts with one mark and a space; '' where there is none."""
    text = lines.stripped(F.col("line"))
    first = F.min_by(lines.stripped(F.substring(text, 3, 1 << 30)), F.when(text.startswith("# "), F.col("pos")))
    return rows.groupBy("doc_id").agg(F.coalesce(first, F.lit("")).alias("title"))


def doc_features(docs: DataFrame) -> DataFrame:
    """Tables, images and formulas of every document: blocks in double marks, maybe empty; inline ones in single marks, maybe over lines."""
    text = F.coalesce("text", F.lit(""))
    block = F.regexp_count(text, F.lit(r"(?s)\$\$.*?\$\$"))
    inline = F.regexp_count(text, F.lit(r"(?<!\$)\$(?!\$)[^$]+?(?<!\$)\$(?!\$)"))
    return docs.select("doc_id", F.regexp_count(text, F.lit("(?i)<table")).alias("tables"), F.regexp_count(text, F.lit(r"!\[[^\]]*\]\([^)]*\)")).alias("images"), block.alias("blocks"), inline.alias("inline"))


def greedy(parts: list[str], size: int, joint: str) -> list[str]:
    """Neighbours joined as long as they stay within the size; a longer part stands alone, empty ones are left out."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= size:
            out[-1] = out[-1] + joint + part if out[-1] else part
        else:
            out.append(part)
    return [o for o in out if o]


def chunks_of(text: str, size: int) -> list[tuple[str | None, int | None, str]]:
    """(strategy, section, text) of a text's chunks; chunks of one section overlap, those without a number do not."""
    if len(text) <= size:
        return [(None, None, text)]
    starts = [m.start() for m in re.finditer(HEADING, text, re.M)]
    if len(starts) < 2:
        return [("paragraph", 0, p) for p in greedy([p for p in map(str.strip, text.split("\n\n")) if p], size, "\n\n")]
    out: list[tuple[str | None, int | None, str]] = []
    for k, (at, to) in enumerate(zip([0, *starts], [*starts, len(text)], strict=True)):
        section = text[at:to].strip()
        if len(section) <= size:
            out += [("heading", None, section)] if section else []
            continue
        for p in greedy(section.split("\n\n"), size, "\n\n"):
            sentences = [s for s in re.findall(SENTENCE, p) if s.strip()]
            out += [("paragraph", k, p)] if len(p) <= size else [("sentence", k, s) for s in greedy(sentences, size, "")]
    return out


def chunk_documents(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc_id, source, section, chunk_index, chunk_total, strategy, text of the chunks of every document, without overlap.

    A text within the size stays whole, without section, index, total or strategy. With two headings or more a text is cut
    at them; a longer section is packed by paragraphs, and its longer paragraphs by sentences. Other texts are packed by
    paragraphs, a longer one being a chunk of its own. Null texts give no chunk.
    """
    small_batches(docs.sparkSession)

    def pack(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches_:
            out = []
            for doc, source, text in zip(batch["doc_id"], batch["source"], batch["text"], strict=True):
                made = chunks_of(text, size)
                out += [(doc, source, section, k if strategy else None, len(made) if strategy else None, strategy, c) for k, (strategy, section, c) in enumerate(made)]
            frame = pd.DataFrame(out, columns=["doc_id", "source", "section", "chunk_index", "chunk_total", "strategy", "text"])
            yield frame.astype({"section": "Int64", "chunk_index": "Int64", "chunk_total": "Int64"})

    return docs.select("doc_id", "source", "text").where("text is not null").mapInPandas(pack, "doc_id long, source string, section long, chunk_index long, chunk_total long, strategy string, text string")


def chunk_overlap(chunks: DataFrame, size: int = CHUNK, ratio: float = OVERLAP) -> DataFrame:
    """Each chunk led by the end of the one before it in its section, if that one is longer than the overlap; chunks without a section stay."""
    n = int(size * ratio)
    before = F.lag("text").over(W.partitionBy("doc_id", "section").orderBy("chunk_index"))
    return chunks.withColumn("text", F.when(F.col("section").isNotNull() & (F.length(before) > n), F.concat(F.right(before, F.lit(n)), F.lit("\n"), F.col("text"))).otherwise(F.col("text")))


class _Grid(HTMLParser):
    """Rows of cells (text, columns it covers, rows it covers) of the outermost table."""

    def __init__(self):
        super().__init__()
        self.rows, self.parts, self.span, self.depth = [], None, (1, 1), 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif tag == "tr" and self.depth == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.depth == 1:
            given = dict(attrs)
            self.span = tuple(int(v) if (v := given.get(a) or "1").isdigit() else 1 for a in ("colspan", "rowspan"))
            self.parts = []

    def handle_data(self, data):
        if self.parts is not None and data.strip():
            self.parts.append(data.strip())

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag in ("td", "th") and self.depth == 1 and self.parts is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((" ".join(self.parts), *self.span))
            self.parts = None


def grid_of(html: str) -> list[list[str]]:
    """Cell texts. A wide cell is followed by empty ones. What tall cells carry down stands first in a row, each in its
    first column, and the row's own cells come after all of it; an unclosed cell is left out; rows are padded."""
    parser = _Grid()
    parser.feed(html)
    out, carried = [], []
    for cells in parser.rows:
        row = [""] * (max((at for at, *_ in carried), default=-1) + 1)
        for at, text, _ in carried:
            row[at] = text
        carried = [(at, text, more - 1) for at, text, more in carried if more > 1]
        for text, wide, tall in cells:
            if tall > 1:
                carried.append((len(row), text, tall - 1))
            row += [text] + [""] * (wide - 1)
        out.append(row)
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


def table_cells(tables: DataFrame) -> DataFrame:
    """doc_id, table_idx, row_idx, col_idx, text of every cell."""

    def walk(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches_:
            out = [(d, t, r, c, x) for d, t, h in zip(batch["doc_id"], batch["table_idx"], batch["table_html"], strict=True) for r, row in enumerate(grid_of(h)) for c, x in enumerate(row)]
            yield pd.DataFrame(out, columns=["doc_id", "table_idx", "row_idx", "col_idx", "text"])

    return tables.select("doc_id", "table_idx", "table_html").mapInPandas(walk, "doc_id long, table_idx int, row_idx int, col_idx int, text string")


def tables_to_pipe(cells: DataFrame) -> DataFrame:
    """Each table as lines of cells between bars, a rule after the first, a line feed after the last; line feeds in cells become spaces."""
    text = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    rows = cells.withColumn("text", text).groupBy("doc_id", "table_idx", "row_idx").agg(F.expr("listagg(text, ' | ') within group (order by col_idx)").alias("line"), F.count(F.lit(1)).alias("wide"))
    line = F.concat(F.lit("| "), "line", F.lit(" |"))
    ruled = F.when(F.col("row_idx") == 0, F.concat(line, F.lit("\n|"), F.expr("repeat(' --- |', cast(wide as int))"))).otherwise(line)
    return rows.withColumn("line", ruled).groupBy("doc_id", "table_idx").agg(F.expr("listagg(line, '\n') within group (order by row_idx) || '\n'").alias("pipe"))


def first_object(reply: Column) -> Column:
    """From the first brace to the one that closes it; null where none does. Braces in quotes do not count, and a backslash,
    wherever it stands, takes away the meaning of the next character."""
    start = F.instr(reply, "{")
    tail = F.substring(reply, start, F.lit(1 << 30))
    pieces = F.regexp_extract_all(tail, F.lit(r"(?s)\\.|\\|[\"{}]|[^\\\"{}]+"), F.lit(0))
    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), none.alias("end"))

    def step(s: Column, p: Column) -> Column:
        brace = ~s["quoted"] & p.isin("{", "}")
        depth = F.when(brace, s["depth"] + F.when(p == "{", 1).otherwise(-1)).otherwise(s["depth"])
        at = s["at"] + F.length(p)
        done = F.when(s["end"].isNotNull(), s["end"]).when(brace & (depth == 0), at)
        return F.struct(depth.alias("depth"), F.when(p == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), at.alias("at"), done.alias("end"))

    end = F.aggregate(pieces, begin, step)["end"]
    return F.when(start > 0, F.when(end.isNotNull(), F.substring(tail, F.lit(1), end)))


#: Where an object may be found in a reply, in the order in which it is sought.
STAGES = ("whole", "fenced", "braces", "repaired", "failed")


def parse_llm_json(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The object that a reply holds, and the stage that found it: whole, fenced, braces or repaired; 'failed' rows keep null."""
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    is_object = lambda c: F.coalesce(c.startswith("{") & F.try_parse_json(c).isNotNull(), F.lit(False))
    tries = {
        "whole": trimmed(F.col(reply)), "fenced": trimmed(F.regexp_extract(reply, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)),
        "braces": F.col("_body"), "repaired": F.regexp_replace("_body", r",\s*([}\]])", "$1"),
    }
    found = F.coalesce(*(F.when(is_object(c), F.struct(F.lit(name).alias("stage"), c.alias("object"))) for name, c in tries.items()))
    out = replies.withColumn("_body", first_object(F.col(reply))).withColumn("_found", found)
    return out.withColumn("parse_stage", F.coalesce("_found.stage", F.lit("failed"))).withColumn("object", F.col("_found.object")).drop("_body", "_found")


def parse_into(replies: DataFrame, folder: str, reply: str = "reply") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Parsed rows, failed rows, and how many replies each stage found: all from one pass, which writes the rows in two parts of the folder."""
    seen = Observation()
    counts = [F.count_if(F.col("parse_stage") == name).alias(name) for name in STAGES]
    parsed = parse_llm_json(replies, reply).observe(seen, *counts).withColumn("failed", F.col("parse_stage") == "failed")
    parsed.write.mode("overwrite").partitionBy("failed").parquet(folder)
    rows = replies.sparkSession.read.schema(parsed.schema).parquet(folder)
    return rows.where("not failed").drop("failed"), rows.where("failed").drop("failed"), {name: seen.get[name] for name in STAGES}


def few_shot_block(table: DataFrame, key: str, n: int, complete: Column, example: Column) -> DataFrame:
    """Of the newest n rows of each key, the complete ones as one text."""
    newest = reports.recent_per_key(table, key, n).where(complete).withColumn("_x", example)
    return newest.groupBy(key).agg(F.expr("listagg(_x, '\n') within group (order by rank)").alias("block"))


def validate_ranges(table: DataFrame, key: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """The violations of each row: a value that is missing or out of its bounds."""
    said = [F.when(F.col(c).isNull(), F.lit(f"[{c}] missing")).when(~F.col(c).between(lo, hi), F.lit(f"[{c}] not in {lo:g}..{hi:g}")) for c, (lo, hi) in bounds.items()]
    return table.select(key, F.concat_ws("; ", *said).alias("errors"))


def validation_route(errors: Column, retries: Column, most: int = 3) -> Column:
    return F.when(errors == "", "pass").when(retries < most, "retry").otherwise("fail")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _chunks(s, d):
    return chunk_documents(_docs(s, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


def _replies(s, d):
    e, p = F.col("event_id") % 5, F.col("props")
    reply = F.when(e == 0, p).when(e == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(e == 2, F.concat(F.lit("So: "), p, F.lit(" done"))).when(e == 3, F.concat(F.lit("So: "), F.regexp_replace(p, r"\}$", ", }"))).otherwise("none")
    return s.read.parquet(f"{d}/events.parquet").select("event_id", reply.alias("reply"))


#: Replies with an object in many places or none, by the id modulo 13; the SQL is read by both engines.
_HARD_REPLIES = """(CASE event_id % 13 WHEN 0 THEN props WHEN 1 THEN concat('Here:', chr(10), '```json', chr(10), props, chr(10), '```') WHEN 2 THEN concat('So: ', props, ' done') WHEN 3 THEN concat('So: ', replace(props, '}', ', }'))
 WHEN 4 THEN 'none' WHEN 5 THEN concat('``` ', props, '  ``` and ```{}```') WHEN 6 THEN concat('a "q" {"s": "}{', chr(92), '"", "k": 5, "o": ', props, '} tail }') WHEN 7 THEN concat('see ', chr(92), '{ and ', props)
 WHEN 8 THEN concat('[', props, ']') WHEN 9 THEN concat('  ', props, chr(10)) WHEN 10 THEN NULL WHEN 11 THEN concat(replace(props, '"', concat(chr(92), '"')), ' ', props) ELSE concat('{', chr(92), '"}', ' "', props) END)"""


def _hard(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(_HARD_REPLIES).alias("reply"))


def _parsed_parts(s, d):
    good, bad, _ = parse_into(_hard(s, d), f"{Scratch(s, 'replies').root}/parsed")
    k = F.get_json_object("object", "$.k").cast("long").alias("k")
    return good.select("event_id", "parse_stage", k).unionByName(bad.select("event_id", "parse_stage", k))


def _parse_counts(s, d):
    _, _, counts = parse_into(_hard(s, d), f"{Scratch(s, 'replies').root}/parsed")
    return s.createDataFrame(list(counts.items()), "parse_stage string, replies long")


def _sunk(s, d):
    folder = f"{Scratch(s, 'chunks').root}/collection"
    sink_chunks(_docs(s, d).select("doc_id", "source", "text"), folder)
    return s.read.parquet(folder).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _cells(s, d):
    return table_cells(batches.extract_tables(batches.html_tables(s, d)))


#: Formulas planted into the documents: over a line end, empty and whole blocks, a lone mark.
_FORMULAS = " $a\nb$ $$$$ $$c$$ $d$$e$ $f"
_BOUNDS = {"p_size": (5, 40), "p_retailprice": (0, 1500)}
QUERIES = {
    "extract_title": lambda s, d: extract_title(lines.noisy_lines(s, d).withColumn("line", F.regexp_replace("line", "^##", "#"))),
    "doc_features": lambda s, d: doc_features(_docs(s, d).withColumn("text", F.concat("text", F.lit(_FORMULAS)))),
    "chunk_documents": lambda s, d: _chunks(s, d).select("doc_id", "chunk_index", "chunk_total", "strategy", F.md5("text").alias("md5")),
    "chunk_overlap": lambda s, d: chunk_overlap(_chunks(s, d)).select("doc_id", "chunk_index", F.md5("text").alias("md5")),
    "sink_chunks": _sunk,
    "table_cells": _cells,
    "chunk_index_total": lambda s, d: _chunks(s, d).select("doc_id", "chunk_index", "chunk_total").where("chunk_index is not null"),
    "chunk_sections": lambda s, d: chunk_overlap(chunk_documents(cleaning.noisy_texts(s, d).withColumn("source", F.lit("noisy")))).select("doc_id", "section", "chunk_index", "chunk_total", "strategy", F.md5("text").alias("md5")),
    "tables_to_pipe": lambda s, d: tables_to_pipe(_cells(s, d).withColumn("text", F.when(F.col("row_idx") % 2 == 1, F.concat("text", F.lit("|\n"), "text")).otherwise(F.col("text")))),
    "parse_llm_json": lambda s, d: parse_llm_json(_replies(s, d)).select("event_id", "parse_stage", F.get_json_object("object", "$.k").cast("long").alias("k")),
    "parse_llm_json_hard": _parsed_parts,
    "parse_llm_counts": _parse_counts,
    "few_shot_lines": lambda s, d: few_shot_block(reports.tasks(s, d), "user_id", 3, F.col("status") == "completed", F.concat(F.lit("Example "), F.col("id").cast("string"))),
    "validate_ranges": lambda s, d: validate_ranges(s.read.parquet(f"{d}/part.parquet"), "p_partkey", _BOUNDS),
    "validation_route": lambda s, d: validate_ranges(s.read.parquet(f"{d}/part.parquet"), "p_partkey", _BOUNDS).select("p_partkey", validation_route(F.col("errors"), F.col("p_partkey") % 5).alias("route")),
}

_PARTS = "p AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS part FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) > 700), q AS MATERIALIZED (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM p WHERE part <> '')"
_CHUNKS = f"{_PARTS}, r AS (SELECT doc_id, k, 0 AS c, length(part) AS n FROM q WHERE k = 1 UNION ALL SELECT q.doc_id, q.k, CASE WHEN r.n + length(q.part) + 2 <= 700 THEN r.c ELSE r.c + 1 END, CASE WHEN r.n + length(q.part) + 2 <= 700 THEN r.n + length(q.part) + 2 ELSE length(q.part) END FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k + 1), c AS (SELECT doc_id, CAST(c AS BIGINT) AS chunk_index, string_agg(part, chr(10) || chr(10) ORDER BY k) AS text FROM r JOIN q USING (doc_id, k) GROUP BY ALL), t AS (SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total, 'paragraph' AS strategy, text FROM c UNION ALL SELECT doc_id, NULL, NULL, NULL, replace(text, chr(10), chr(10) || chr(10)) FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) <= 700)"
_CELLS = "l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r, l_partkey AS a, l_suppkey AS b FROM lineitem), cells AS (SELECT doc_id, 0 AS table_idx, r AS row_idx, 0 AS col_idx, CAST(a AS VARCHAR) AS text FROM l UNION ALL SELECT doc_id, 0, r, 1, CAST(b AS VARCHAR) FROM l)"
_ERR = "e AS (SELECT p_partkey, concat_ws('; ', CASE WHEN p_size IS NULL THEN '[p_size] missing' WHEN p_size NOT BETWEEN 5 AND 40 THEN '[p_size] not in 5..40' END, CASE WHEN p_retailprice IS NULL THEN '[p_retailprice] missing' WHEN p_retailprice NOT BETWEEN 0 AND 1500 THEN '[p_retailprice] not in 0..1500' END) AS errors FROM part)"
# DuckDB reads a comma before a closing bracket, which JSON does not have: such texts are left out by hand.
_HARD = f"""
WITH RECURSIVE e AS (SELECT event_id, {_HARD_REPLIES} AS reply FROM events), t AS (SELECT event_id, substr(reply, instr(reply, '{{')) AS tail FROM e WHERE instr(reply, '{{') > 0),
w AS (SELECT event_id, tail, 0 AS i, 0 AS depth, false AS quoted, false AS skip, false AS done FROM t UNION ALL
    SELECT event_id, tail, i + 1, CASE WHEN skip OR quoted THEN depth WHEN c = '{{' THEN depth + 1 WHEN c = '}}' THEN depth - 1 ELSE depth END, CASE WHEN NOT skip AND c = '"' THEN NOT quoted ELSE quoted END,
           NOT skip AND c = chr(92), NOT skip AND NOT quoted AND c = '}}' AND depth = 1
    FROM (SELECT *, substr(tail, i + 1, 1) AS c FROM w WHERE NOT done AND i < length(tail))),
b AS (SELECT event_id, substr(tail, 1, i) AS body FROM w WHERE done),
f AS (SELECT event_id, trim(reply, ' ' || chr(10)) AS a, trim(regexp_extract(reply, '(?s)```(?:json)?\\s*\\n?(.*?)\\n?\\s*```', 1), ' ' || chr(10)) AS c, body, regexp_replace(body, ',\\s*([}}\\]])', '\\1', 'g') AS r FROM e LEFT JOIN b USING (event_id)),
s AS (SELECT event_id, list_filter([{{'s': 'whole', 'o': TRY_CAST(a AS JSON)}}, {{'s': 'fenced', 'o': TRY_CAST(c AS JSON)}}, {{'s': 'braces', 'o': TRY_CAST(body AS JSON)}}, {{'s': 'repaired', 'o': TRY_CAST(r AS JSON)}}], lambda x: json_type(x.o) = 'OBJECT' AND NOT regexp_matches(CAST(x.o AS VARCHAR), ',\\s*[}}\\]]'))[1] AS x FROM f)"""
ORACLES = {
    "parse_llm_json_hard": f"{_HARD} SELECT event_id, coalesce(x.s, 'failed') AS parse_stage, CAST(json_extract_string(x.o, '$.k') AS BIGINT) AS k FROM s",
    "parse_llm_counts": f"{_HARD} SELECT n.parse_stage, count(event_id) AS replies FROM (SELECT unnest(['whole', 'fenced', 'braces', 'repaired', 'failed']) AS parse_stage) n LEFT JOIN s ON coalesce(x.s, 'failed') = n.parse_stage GROUP BY 1",
    "extract_title": f"WITH {lines.NOISY_SQL}, h AS (SELECT doc_id, pos, trim(regexp_replace(line, '^##', '#')) AS t FROM lines) SELECT doc_id, coalesce(min_by(trim(substr(t, 3)), pos) FILTER (t LIKE '# %'), '') AS title FROM h GROUP BY doc_id",
    "doc_features": r"WITH d AS (SELECT doc_id, coalesce(text || '" + _FORMULAS.replace(chr(10), "' || chr(10) || '") + r"', '') AS t FROM documents) SELECT doc_id, len(regexp_extract_all(t, '(?i)<table')) AS tables, len(regexp_extract_all(t, '!\[[^\]]*\]\([^)]*\)')) AS images, len(regexp_extract_all(t, '(?s)\$\$.*?\$\$')) AS blocks, len(regexp_extract_all(regexp_replace(t, '\$\$+', chr(1), 'g'), '\$[^$\x01]+\$')) AS inline FROM d",
    "chunk_documents": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, chunk_total, strategy, md5(text) AS md5 FROM t",
    "chunk_overlap": f"WITH RECURSIVE {_CHUNKS}, o AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b FROM t) SELECT doc_id, chunk_index, md5(CASE WHEN length(b) > 105 THEN right(b, 105) || chr(10) || text ELSE text END) AS md5 FROM o",
    "chunk_index_total": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, chunk_total FROM t WHERE chunk_index IS NOT NULL",
    "sink_chunks": "SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source",
    "table_cells": f"WITH {_CELLS} SELECT * FROM cells",
    "tables_to_pipe": f"WITH {_CELLS}, r AS (SELECT doc_id, table_idx, row_idx, '| ' || string_agg(CASE WHEN row_idx % 2 = 1 THEN text || '\\| ' || text ELSE text END, ' | ' ORDER BY col_idx) || ' |' || repeat(chr(10) || '|' || repeat(' --- |', count(*)), CASE WHEN min(row_idx) = 0 THEN 1 ELSE 0 END) AS line FROM cells GROUP BY doc_id, table_idx, row_idx) SELECT doc_id, table_idx, string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS pipe FROM r GROUP BY ALL",
    "parse_llm_json": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'fenced' WHEN 2 THEN 'braces' WHEN 3 THEN 'repaired' ELSE 'failed' END AS parse_stage, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "few_shot_lines": f"WITH {reports.TASKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM tasks) SELECT user_id, string_agg('Example ' || id, chr(10) ORDER BY rank) AS block FROM r WHERE rank <= 3 AND status = 'completed' GROUP BY user_id",
    "validate_ranges": f"WITH {_ERR} SELECT * FROM e",
    "validation_route": f"WITH {_ERR} SELECT p_partkey, CASE WHEN errors = '' THEN 'pass' WHEN p_partkey % 5 < 3 THEN 'retry' ELSE 'fail' END AS route FROM e",
}
