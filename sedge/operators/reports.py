"""Relational reports over the job, template, conversation and registry tables.

Each operator is a function of DataFrames; the queries feed it tables derived from the given ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Job states (fixed values).
STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    standard = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_partkey") >= 100, F.concat(F.lit("GB/T "), F.col("p_partkey").cast("string")))
    owner = F.when(F.col("p_size") % 3 != 0, F.col("p_size"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), standard.alias("standard"), owner.alias("user_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(p_size)").alias("created_at"))


TASKS_SQL = "tasks AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status, o_orderdate AS created_at, o_totalprice AS price FROM orders)"
TEMPLATES_SQL = "templates AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey >= 100 THEN 'GB/T ' || p_partkey END AS standard, CASE WHEN p_size % 3 <> 0 THEN p_size END AS user_id, TIMESTAMP '2024-01-01' + to_days(p_size) AS created_at FROM part)"


def filter_optional_eq(table: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; an empty or missing value asks nothing."""
    for column, value in wanted.items():
        if value:
            table = table.where(F.col(column) == value)
    return table


def filter_visibility(table: DataFrame, user, owner: str = "user_id") -> DataFrame:
    """A user's own rows and those that belong to nobody."""
    return table.where((F.col(owner) == user) | F.col(owner).isNull())


def count_by_status(table: DataFrame) -> DataFrame:
    """A row for each known status, zero where there is none, and the total of all rows, unknown states included."""
    spark = table.sparkSession
    counted = table.groupBy("status").agg(F.count(F.lit(1)).alias("n"))  # as many rows as states
    known = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    rows = known.join(counted.hint("merge"), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.unionByName(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("status"), "n"))


def paginate(table: DataFrame, page: int, size: int, newest: str = "created_at", tie: str = "id") -> DataFrame:
    """One page by newest first; page from 1, size from 1 to 100. Equal times are ordered by id."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    return table.orderBy(F.desc(newest), tie).offset((page - 1) * size).limit(size)


def recent_per_key(table: DataFrame, key: str, n: int, newest: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest n rows of every key."""
    return table.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(newest), tie))).where(F.col("rank") <= n)


def orphans(outputs: DataFrame, known: DataFrame) -> DataFrame:
    """Outputs whose id no job has."""
    return outputs.join(known.select("id").hint("merge"), "id", "left_anti")


def cleanup_candidates(folders: DataFrame, jobs: DataFrame, cutoff) -> DataFrame:
    """What a cleanup would free: orphans changed before the cutoff, and finished jobs created before it. Nothing is deleted."""
    both = folders.join(jobs.select("id", "status", "created_at", F.lit(True).alias("known")).hint("merge"), "id", "left")
    orphan = F.col("known").isNull() & (F.col("mtime") < cutoff)
    done = F.col("status").isin(*TERMINAL) & (F.col("created_at") < cutoff)
    return both.agg(
        F.count_if(F.coalesce(orphan | done, F.lit(False))).alias("deleted_count"),
        F.round(F.coalesce(F.sum(F.when(F.coalesce(orphan | done, F.lit(False)), F.col("bytes"))), F.lit(0)) / 1048576, 2).alias("freed_mb"),
        F.count(F.lit(1)).alias("scanned_count"),
        F.count_if(F.col("known").isNull()).alias("orphaned_count"),
    )


def session_message_counts(sessions: DataFrame, messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Messages of every session, 0 where there are none."""
    counted = messages.groupBy(key).agg(F.count(F.lit(1)).alias("messages"))
    return sessions.join(counted.hint("merge"), key, "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def session_messages(messages: DataFrame, limit: int | None = None, key: str = "conv_id") -> DataFrame:
    """Every session's messages numbered by turn from 1; a limit holds for each session."""
    numbered = messages.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("turn", "role")))
    return numbered.where(F.col("n") <= limit) if limit else numbered


def template_match(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The template of each wanted standard: equal standard, then a standard or else a name that holds its number.

    The number is the first longest run of digits; levels 2 and 3 ask for three digits at least. The newest template of
    the best level wins. `wanted` is made distinct first and so bounded by the standards in use; each level is a join
    on a key: level 1 on the standard, levels 2 and 3 on the digit runs of the text, cut to every length asked for.
    """
    runs = F.regexp_extract_all("wanted", F.lit("[0-9]+"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    asked = wanted.where("wanted <> ''").select("wanted").distinct().withColumn("kw", longest)
    one = asked.join(known.hint("merge"), asked["wanted"] == known["standard"]).select("wanted", F.lit(1).alias("level"), "id", "created_at")

    def pieces(text: str) -> DataFrame:
        run = known.select("id", "created_at", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))).alias("run"))
        at = run.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("run"))))
        return at.withColumn("n", F.explode(F.when(F.length("run") - F.col("start") >= 2, F.sequence(F.lit(3), F.length("run") - F.col("start") + 1)))).select("id", "created_at", F.expr("substring(run, start, n)").alias("kw")).distinct()

    keyed = asked.where(F.length("kw") >= 3)
    two = keyed.join(pieces("standard").hint("merge"), "kw").select("wanted", F.lit(2).alias("level"), "id", "created_at")
    three = keyed.join(pieces("name").hint("merge"), "kw").select("wanted", F.lit(3).alias("level"), "id", "created_at")
    found = one.unionByName(two).unionByName(three)
    rank = F.row_number().over(W.partitionBy("wanted").orderBy("level", F.desc("created_at"), "id"))
    return found.withColumn("rank", rank).where("rank = 1").select("wanted", "level", F.col("id").alias("template_id"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, doomed: DataFrame, by: str, session: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """The sessions and messages that stay once the sessions whose `by` (their id, or their task) is among the doomed ones are
    deleted with their messages. A null `by` is never deleted; messages without a session stay."""
    keys = doomed.select(by).where(F.col(by).isNotNull()).distinct().hint("merge")
    gone = sessions.join(keys, by, "left_semi").select(session).distinct()
    return sessions.join(keys, by, "left_anti"), messages.join(gone.hint("merge"), session, "left_anti")


def registry_sync(files: DataFrame, registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """The registry after a rebuild: files without a row are added as indexed, rows of files get fresh counts and that
    status, rows without a file stay. Files other than Markdown are passed over."""
    files = files.where(F.col("source").endswith(".md"))
    counted = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("fresh"))
    present = files.join(counted.hint("merge"), "source", "left").select("source", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    both = registry.join(present.hint("merge"), "source", "full_outer")
    on_disk = F.col("fresh").isNotNull()
    return both.select("source", F.when(on_disk, F.col("fresh")).otherwise(F.col("chunk_count")).alias("chunk_count"), F.when(on_disk, "indexed").otherwise(F.col("status")).alias("status"))


def kb_stats(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.coalesce(F.sum(F.coalesce("chunk_count", F.lit(0))), F.lit(0)).alias("chunks"),
    )


def _registry(spark, d):
    n = _read(spark, d, "supplier")
    return n.select(F.col("s_name").alias("source"), F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey").cast("long")).alias("chunk_count"), F.when(F.col("s_nationkey") % 3 == 0, "pending").otherwise("indexed").alias("status"))


_REG = "reg AS (SELECT s_name AS source, CASE WHEN s_nationkey % 4 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS chunk_count, CASE WHEN s_nationkey % 3 = 0 THEN 'pending' ELSE 'indexed' END AS status FROM supplier)"

_NAMED = "source || CASE WHEN source LIKE '%3' THEN '.pdf' ELSE '.md' END"


def _sync(spark, d):
    docs = _read(spark, d, "documents")
    chunks = docs.select(F.concat(F.lit("Supplier#"), F.lpad(F.regexp_extract("source", "[0-9]+", 0), 9, "0")).alias("source"))
    extra = spark.range(1).select(F.explode(F.array(F.lit("new.md"), F.lit("new.pdf"))).alias("source"))
    # Every tenth file is no Markdown.
    named = lambda f: f.withColumn("source", F.concat("source", F.when(F.col("source").endswith("3"), ".pdf").otherwise(".md")))
    registry = named(_registry(spark, d))
    return registry_sync(registry.where("chunk_count is not null").select("source").unionByName(extra), registry, named(chunks))


def _folders(spark, d):
    l = _read(spark, d, "lineitem")
    return l.groupBy((F.col("l_orderkey") * 2).alias("id")).agg(F.sum(F.col("l_quantity").cast("long") * 4096).alias("bytes"), F.min("l_shipdate").alias("mtime"))


_FOLD = "folders AS (SELECT l_orderkey * 2 AS id, CAST(sum(CAST(l_quantity AS BIGINT) * 4096) AS BIGINT) AS bytes, min(l_shipdate) AS mtime FROM lineitem GROUP BY 1)"
_CUT = "1997-01-01"


def _sessions(spark, d):
    return _read(spark, d, "conversations").select("conv_id").distinct()


def _deleted(spark, d):
    """Rows left by session once two of seven tasks are deleted; the doomed tasks are those of the first two nations."""
    sessions = _sessions(spark, d).withColumn("task", F.col("conv_id") % 7)
    doomed = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("task")).where("task < 2")
    left, said = delete_sessions(sessions, _read(spark, d, "conversations"), doomed, "task")
    counts = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return left.join(counts.hint("merge"), "conv_id", "full_outer").select("conv_id", "task", "n_messages")


def _wanted(spark, d):
    return _read(spark, d, "orders").select(F.concat(F.lit("GB/T "), (F.col("o_orderkey") % 3000).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "-2008").otherwise("")).alias("wanted"))


def _file_names(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("gbt_{}_{}.md", "gb-{}.PDF", "GB_T_{}_2008.txt", "notes{}.docx", "GB_Z_{}_1999.pdf"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.replace(F.replace(kinds, F.lit("{}_{}"), F.concat(F.col("p_partkey").cast("string"), F.lit("_"), (F.col("p_size") + 1990).cast("string"))), F.lit("{}"), F.col("p_partkey").cast("string"))
    return _read(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("file_name"))


_FILES = "files AS (SELECT p_partkey AS id, replace(replace((['gbt_{}_{}.md', 'gb-{}.PDF', 'GB_T_{}_2008.txt', 'notes{}.docx', 'GB_Z_{}_1999.pdf'])[p_partkey % 5 + 1], '{}_{}', p_partkey || '_' || (p_size + 1990)), '{}', CAST(p_partkey AS VARCHAR)) AS file_name FROM part)"


def standard_id(name):
    """GB/T n-y or GB n as a file name tells them; else the name itself."""
    a, b = F.regexp_extract(name, r"(?i)gbt[_-](\d+)[_-](\d{4})", 1), F.regexp_extract(name, r"(?i)gbt[_-](\d+)[_-](\d{4})", 2)
    c = F.regexp_extract(name, r"(?i)gb[_-](\d+)", 1)
    return F.when(a != "", F.concat(F.lit("GB/T "), a, F.lit("-"), b)).when(c != "", F.concat(F.lit("GB "), c)).otherwise(F.col(name))


def registry_key(standard):
    """Lower case without slashes; spaces and dashes become single underscores, none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(standard), " -/", "__"), "_+", "_"), F.lit("_"))


def latest_activity(messages: DataFrame) -> DataFrame:
    """A session's last turn, and a title from its first user message: 30 characters, marked where more follow."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    title = F.when(F.length("t") > 30, F.concat(F.substring("t", 1, 30), F.lit("..."))).otherwise(F.col("t"))
    return messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), first.alias("t")).select("conv_id", "last_turn", title.alias("title"))


QUERIES = {
    "filter_optional_eq": lambda s, d: filter_optional_eq(tasks(s, d), user_id=None, status="completed").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
    "filter_visibility": lambda s, d: filter_visibility(templates(s, d), 7).select("id", "name", "user_id"),
    "count_by_status": lambda s, d: count_by_status(tasks(s, d)),
    "paginate": lambda s, d: paginate(tasks(s, d), 3, 50).select("id", "status", "created_at"),
    "recent_per_key": lambda s, d: recent_per_key(tasks(s, d), "user_id", 3).select("user_id", "rank", "id"),
    "orphan_outputs": lambda s, d: orphans(_folders(s, d), tasks(s, d)).select("id", "bytes"),
    "cleanup_candidates": lambda s, d: cleanup_candidates(_folders(s, d), tasks(s, d), F.lit(_CUT).cast("timestamp_ntz")),
    "disk_usage": lambda s, d: _folders(s, d).agg(F.bround(F.sum(F.when(F.col("id") % 4 == 0, F.col("bytes"))) / 1048576, 2).alias("outputs_mb"), F.bround(F.sum(F.when(F.col("id") % 4 != 0, F.col("bytes"))) / 1048576, 2).alias("uploads_mb")).withColumn("total_mb", F.bround(F.col("outputs_mb") + F.col("uploads_mb"), 2)),
    "session_message_counts": lambda s, d: session_message_counts(_sessions(s, d).unionByName(_read(s, d, "customer").select(F.col("c_custkey").alias("conv_id"))).distinct(), _read(s, d, "conversations").where("role <> 'system'")),
    "session_messages": lambda s, d: session_messages(_read(s, d, "conversations")).select("conv_id", "n", "turn", "role"),
    "session_message_counts_whole": lambda s, d: session_message_counts(_sessions(s, d).unionByName(_read(s, d, "customer").select(F.col("c_custkey").alias("conv_id"))).distinct(), _read(s, d, "conversations").where("role <> 'system'")),
    "cascade_delete_by_task": _deleted,
    "cascade_delete": lambda s, d: _read(s, d, "conversations").join(_sessions(s, d).where("conv_id % 5 = 0").hint("merge"), "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("left_messages")),
    "template_match": lambda s, d: template_match(_wanted(s, d), templates(s, d)),
    "kb_registry_sync": _sync,
    "kb_stats": lambda s, d: kb_stats(_registry(s, d)),
    "chunks_per_source": lambda s, d: _read(s, d, "documents").select(F.concat(F.lit("data/raw/"), F.col("source"), F.lit(".md")).alias("path")).where("path <> ''").groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("name")).agg(F.count(F.lit(1)).alias("chunks")),
    "messages_chronological": lambda s, d: _read(s, d, "conversations").orderBy("conv_id", "turn").select("conv_id", "turn", "role"),
    "sessions_by_recency": lambda s, d: _read(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "id").offset(20).limit(20),
    "filter_supported_ext": lambda s, d: _file_names(s, d).withColumn("ext", F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))).withColumn("kept", F.col("ext").isin("pdf", "md", "txt")),
    "standard_id_from_filename": lambda s, d: _file_names(s, d).select("id", standard_id("file_name").alias("standard_id")),
    "standard_registry_key": lambda s, d: templates(s, d).where("standard is not null").select("id", registry_key("standard").alias("key")),
    "batch_create_summary": lambda s, d: _file_names(s, d).agg(F.count_if(F.lower("file_name").rlike(r"\.(pdf|md|txt)$")).alias("created"), F.count_if(~F.lower("file_name").rlike(r"\.(pdf|md|txt)$")).alias("skipped")),
    "union_formats": lambda s, d: _file_names(s, d).where("file_name like '%.md'").select("id", F.lit("md").alias("format")).unionByName(_file_names(s, d).where("file_name like '%.txt'").select("id", F.lit("txt").alias("format"))),
    "missing_ids": lambda s, d: _read(s, d, "customer").select(F.col("c_custkey").alias("id")).join(tasks(s, d).select(F.col("user_id").alias("id")).hint("merge"), "id", "left_anti"),
    "session_activity": lambda s, d: latest_activity(_read(s, d, "conversations")),
    "project_task_info": lambda s, d: _read(s, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.length(F.get_json_object("props", "$.path")) > 0, F.lit(False)).alias("has_path")),
    "partial_update": lambda s, d: (lambda t, u: t.join(u.hint("merge"), "id", "left").select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_standard", "standard").alias("standard")))(templates(s, d), _read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).alias("new_name"), F.when(F.col("s_nationkey") % 3 == 0, F.lit("GB 1")).alias("new_standard"))),
}

ORACLES = {
    "filter_optional_eq": f"WITH {TASKS_SQL} SELECT user_id, count(*) AS n FROM tasks WHERE status = 'completed' GROUP BY user_id",
    "filter_visibility": f"WITH {TEMPLATES_SQL} SELECT id, name, user_id FROM templates WHERE user_id = 7 OR user_id IS NULL",
    "count_by_status": f"WITH {TASKS_SQL}, k AS (SELECT unnest(['pending', 'processing', 'completed', 'failed', 'cancelled']) AS status) SELECT k.status, count(id) AS n FROM k LEFT JOIN tasks USING (status) GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM tasks",
    "paginate": f"WITH {TASKS_SQL} SELECT id, status, created_at FROM tasks ORDER BY created_at DESC, id LIMIT 50 OFFSET 100",
    "recent_per_key": f"WITH {TASKS_SQL} SELECT * FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS INT) AS rank, id FROM tasks) WHERE rank <= 3",
    "orphan_outputs": f"WITH {TASKS_SQL}, {_FOLD} SELECT id, bytes FROM folders WHERE id NOT IN (SELECT id FROM tasks)",
    "cleanup_candidates": f"WITH {TASKS_SQL}, {_FOLD}, b AS (SELECT f.*, t.id IS NULL AS orphan, coalesce(CASE WHEN t.id IS NULL THEN mtime < TIMESTAMP '{_CUT}' ELSE status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '{_CUT}' END, false) AS del FROM folders f LEFT JOIN tasks t USING (id)) SELECT count(*) FILTER (del) AS deleted_count, round(coalesce(sum(bytes) FILTER (del), 0) / 1048576, 2) AS freed_mb, count(*) AS scanned_count, count(*) FILTER (orphan) AS orphaned_count FROM b",
    "disk_usage": f"WITH {_FOLD}, p AS (SELECT round_even(sum(bytes) FILTER (id % 4 = 0) / 1048576, 2) AS outputs_mb, round_even(sum(bytes) FILTER (id % 4 <> 0) / 1048576, 2) AS uploads_mb FROM folders) SELECT *, round_even(outputs_mb + uploads_mb, 2) AS total_mb FROM p",
    "session_message_counts": "WITH i AS (SELECT conv_id FROM conversations UNION SELECT c_custkey FROM customer) SELECT i.conv_id, count(role) AS messages FROM i LEFT JOIN (SELECT conv_id, role FROM conversations WHERE role <> 'system') USING (conv_id) GROUP BY 1",
    "session_messages": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INT) AS n, turn, role FROM conversations",
    "session_message_counts_whole": "WITH i AS (SELECT conv_id FROM conversations UNION SELECT c_custkey FROM customer) SELECT i.conv_id, count(role) AS messages FROM i LEFT JOIN (SELECT conv_id, role FROM conversations WHERE role <> 'system') USING (conv_id) GROUP BY 1",
    "cascade_delete_by_task": "SELECT conv_id, conv_id % 7 AS task, count(*) AS n_messages FROM conversations WHERE conv_id % 7 NOT IN (0, 1) GROUP BY ALL",
    "cascade_delete": "SELECT conv_id, count(*) AS left_messages FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id",
    "template_match": f"""WITH {TEMPLATES_SQL}, w AS (SELECT DISTINCT 'GB/T ' || (o_orderkey % 3000) || CASE WHEN o_orderkey % 7 = 0 THEN '-2008' ELSE '' END AS wanted FROM orders),
k AS (SELECT wanted, list_reduce(regexp_extract_all(wanted, '[0-9]+'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, '') AS kw FROM w),
m AS (SELECT wanted, CASE WHEN standard = wanted THEN 1 WHEN length(kw) >= 3 AND contains(standard, kw) THEN 2 WHEN length(kw) >= 3 AND contains(name, kw) THEN 3 END AS level, id, created_at FROM k CROSS JOIN templates)
SELECT wanted, level, template_id FROM (SELECT wanted, level, id AS template_id, row_number() OVER (PARTITION BY wanted ORDER BY level, created_at DESC, id) AS r FROM m WHERE level IS NOT NULL) WHERE r = 1""",
    "kb_registry_sync": f"WITH {_REG}, named AS (SELECT {_NAMED} AS source, chunk_count, status FROM reg), f AS (SELECT source FROM named WHERE source LIKE '%.md' AND chunk_count IS NOT NULL UNION ALL SELECT 'new.md'), c AS (SELECT {_NAMED} AS source, count(*) AS n FROM (SELECT 'Supplier#' || lpad(regexp_extract(source, '[0-9]+'), 9, '0') AS source FROM documents) GROUP BY 1), p AS (SELECT f.source, coalesce(n, 0) AS fresh FROM f LEFT JOIN c USING (source)) SELECT coalesce(named.source, p.source) AS source, CASE WHEN fresh IS NOT NULL THEN fresh ELSE chunk_count END AS chunk_count, CASE WHEN fresh IS NOT NULL THEN 'indexed' ELSE status END AS status FROM named FULL OUTER JOIN p ON p.source = named.source",
    "kb_stats": f"WITH {_REG} SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'pending') AS pending, CAST(coalesce(sum(coalesce(chunk_count, 0)), 0) AS BIGINT) AS chunks FROM reg",
    "chunks_per_source": "SELECT source || '.md' AS name, count(*) AS chunks FROM documents GROUP BY 1",
    "messages_chronological": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn",
    "sessions_by_recency": "SELECT user_id AS id, max(ts) AS updated_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 20",
    "filter_supported_ext": rf"WITH {_FILES}, e AS (SELECT *, lower(regexp_extract(file_name, '\.([^.]+)$', 1)) AS ext FROM files) SELECT *, ext IN ('pdf', 'md', 'txt') AS kept FROM e",
    "standard_id_from_filename": rf"WITH {_FILES} SELECT id, CASE WHEN regexp_matches(file_name, '(?i)gbt[_-]\d+[_-]\d{{4}}') THEN 'GB/T ' || regexp_extract(file_name, '(?i)gbt[_-](\d+)[_-](\d{{4}})', 1) || '-' || regexp_extract(file_name, '(?i)gbt[_-](\d+)[_-](\d{{4}})', 2) WHEN regexp_matches(file_name, '(?i)gb[_-]\d+') THEN 'GB ' || regexp_extract(file_name, '(?i)gb[_-](\d+)', 1) ELSE file_name END AS standard_id FROM files",
    "standard_registry_key": f"WITH {TEMPLATES_SQL} SELECT id, 'gbt_' || substr(standard, 6) AS key FROM templates WHERE standard IS NOT NULL",
    "batch_create_summary": rf"WITH {_FILES} SELECT count(*) FILTER (regexp_matches(lower(file_name), '\.(pdf|md|txt)$')) AS created, count(*) FILTER (NOT regexp_matches(lower(file_name), '\.(pdf|md|txt)$')) AS skipped FROM files",
    "union_formats": f"WITH {_FILES} SELECT id, 'md' AS format FROM files WHERE file_name LIKE '%.md' UNION ALL SELECT id, 'txt' FROM files WHERE file_name LIKE '%.txt'",
    "missing_ids": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "session_activity": "WITH a AS (SELECT conv_id, max(turn) AS last_turn, min_by(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id) SELECT conv_id, last_turn, CASE WHEN length(t) > 30 THEN t[1:30] || '...' ELSE t END AS title FROM a",
    "project_task_info": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(length(json_extract_string(props, '$.path')) > 0, false) AS has_path FROM events",
    "partial_update": f"WITH {TEMPLATES_SQL} SELECT t.id, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN s_name END, name) AS name, coalesce(CASE WHEN s_nationkey % 3 = 0 THEN 'GB 1' END, standard) AS standard FROM templates t LEFT JOIN supplier ON s_suppkey = t.id",
}
