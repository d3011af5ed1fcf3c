"""Language-model batches, style profiles and ordered keyed rules."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sedge.workspace import dealt_by

#: Placeholder forms and limits of prompts.
CONTEXT_TOKENS = 6000


def estimate_tokens(text: Column) -> Column:
    """max(1, round(length / 1.5)); 0 for an empty text."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 1.5 + 0.5))).cast("long")


def context_window(messages: DataFrame, limit: int = CONTEXT_TOKENS, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The newest messages of every conversation whose half lengths, with those of its system messages, stay within the
    limit, and how many older ones were cut. Sums grow with every step back, so the filter stops where a walk would."""
    cost = F.floor(F.length("text") / 2)
    system = F.sum(F.when(F.col("role") == "system", cost).otherwise(0)).over(W.partitionBy(key))
    said = messages.withColumn("fixed", system).where("role <> 'system'").withColumn("cost", cost)
    newest = W.partitionBy(key).orderBy(F.desc(turn))
    run = said.withColumn("used", F.sum("cost").over(newest.rowsBetween(W.unboundedPreceding, 0)) + F.col("fixed"))
    kept = run.withColumn("total", F.count(F.lit(1)).over(W.partitionBy(key))).where(F.col("used") <= limit)
    return kept.withColumn("cut", F.col("total") - F.count(F.lit(1)).over(W.partitionBy(key))).select(key, turn, "role", F.col("used").cast("long").alias("used"), "cut")


def modal_style(observed: DataFrame, key: str, order: list[str], attributes: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """The commonest value of every attribute for each key; nulls do not vote, ties go to the value seen first.

    defaults: values, with no votes, for attributes for which nothing votes. Values are counted where they lie; a key's whole
    observations never meet in one place.
    """
    pos = F.struct(*order)
    long = observed.select(key, pos.alias("pos"), F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes))).alias("x")).select(key, "pos", "x.*")
    votes = long.where(F.col("value").isNotNull()).groupBy(key, "attribute", "value").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"))
    first = F.row_number().over(W.partitionBy(key, "attribute").orderBy(F.desc("votes"), "first"))
    best = votes.withColumn("r", first).where("r = 1").select(key, "attribute", "value", "votes")
    if not defaults:
        return best
    given = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("_d")) for a, v in defaults.items()))).alias("x")
    wanted = observed.select(key).distinct().select(key, given).select(key, "x.*")
    met = best.join(wanted.hint("merge"), [key, "attribute"], "full_outer")
    return met.select(key, "attribute", F.coalesce("value", "_d").alias("value"), F.coalesce("votes", F.lit(0).cast("long")).alias("votes"))


def sampled_modal_style(observed: DataFrame, key: str, order: list[str], attributes: list[str], n: int) -> DataFrame:
    """modal_style over the first n observations of each key."""
    first = dealt_by(observed, key).withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    return modal_style(first, key, order, attributes)


def first_match_style(observed: DataFrame, key: str, order: list[str], attributes: list[str], matches: Column) -> DataFrame:
    """The attributes of a key's first matching observation; null where none matches."""
    best = F.min_by(F.struct(*attributes), F.when(matches, F.struct(*order)))
    return observed.groupBy(key).agg(best.alias("s")).select(key, *(F.col(f"s.{a}").alias(a) for a in attributes))


def style_diff(pairs: DataFrame, names: list[str]) -> DataFrame:
    """'name: old → new' of every attribute that differs between old_* and new_*, joined by '; '."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    parts = [F.when(~F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}")), F.concat(F.lit(f"{n}: "), show(f"old_{n}"), F.lit(" → "), show(f"new_{n}"))) for n in names]
    return pairs.withColumn("diff", F.concat_ws("; ", *parts))


def rate_limit(requests: DataFrame, limit: int, seconds: int, key: str = "user_id") -> DataFrame:
    """Every request with whether it is accepted: fewer than `limit` accepted ones lie within the seconds before it.

    Rejected requests are not recorded, so the rule must walk a key's requests in order. Partitions are sorted by key
    and time and read as a stream; the only state is the last `limit` accepted times of one key, however many requests
    it has. Equal times are ordered by id. Rows of a null key are one key's.
    """
    span = pd.Timedelta(seconds=seconds)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = object(), deque()
        for batch in batches:
            verdicts = []
            for k, ts in zip(batch["key"], batch["ts"], strict=True):
                if k != current:
                    current, kept = k, deque()
                while kept and ts - kept[0] >= span:
                    kept.popleft()
                verdicts.append(len(kept) < limit)
                if verdicts[-1]:
                    kept.append(ts)
            yield batch.assign(accepted=verdicts)

    # As text, since a null among whole numbers reads as NaN, which equals nothing.
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))
    rows = requests.select(name.alias("key"), "event_id", "ts").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    out = rows.mapInPandas(walk, "key string, event_id long, ts timestamp_ntz, accepted boolean")
    return out.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(requests.schema[key].dataType).alias(key), "event_id", "ts", "accepted")


def status_transition(events: DataFrame, key: str = "task") -> DataFrame:
    """The state of every job after its events in order (ts, event_id).

    A processing event does not bring a cancelled job back; completed notes its time unless one is noted; pending and
    processing clear it. What an event meets depends on the last effective one, which windows can tell.
    """
    order = W.partitionBy(key).orderBy("ts", "event_id")
    settled = F.last(F.when(F.col("status") != "processing", F.col("status")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    live = events.withColumn("settled", settled).where(~((F.col("status") == "processing") & (F.coalesce("settled", F.lit("")) == "cancelled")))
    when = F.struct("ts", "event_id")
    cleared = live.withColumn("cleared", F.max(F.when(F.col("status").isin("pending", "processing"), when)).over(W.partitionBy(key)))
    done = F.min(F.when((F.col("status") == "completed") & (F.col("cleared").isNull() | (when > F.col("cleared"))), F.col("ts")))
    return cleared.groupBy(key).agg(F.max_by("status", when).alias("status"), done.alias("completed_at"), F.count(F.lit(1)).alias("applied"))


def extract_tables(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """Every table of a document in order, and how many of its tags open and close."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[\s>].*?</table>"), F.lit(0))
    out = docs.select(key, F.posexplode(tables).alias("table_idx", "table_html"))
    for tag in ("tr", "td"):
        out = out.withColumn(f"{tag}_open", F.regexp_count("table_html", F.lit(f"(?i)<{tag}[\\s>]"))).withColumn(f"{tag}_close", F.regexp_count("table_html", F.lit(f"(?i)</{tag}>")))
    return out.withColumn("whole", (F.col("tr_open") == F.col("tr_close")) & (F.col("td_open") == F.col("td_close")))


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dealt_by(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")
    row = F.concat(F.lit("<tr><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), F.col("l_suppkey").cast("string"), F.lit("</td></tr>"))
    rows = lines.withColumn("row", row).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "row"))), lambda r: r["row"]), "").alias("rows"))
    return rows.select("doc_id", F.concat(F.lit("<p>x</p><table border=1>"), "rows", F.lit("</table><TABLE><tr><td>1</tr></TABLE>")).alias("html"))


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_status() -> Column:
    """The job status that an event stands for."""
    return F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in _STATUS))


def _status_events(spark, d):
    return _read(spark, d, "events").select(F.col("user_id").alias("task"), "ts", "event_id", event_status().alias("status"))


_STATUS = (("view", "pending"), ("click", "processing"), ("purchase", "completed"), ("error", "failed"), ("signup", "cancelled"))
_ORDER, _ATTRIBUTES = ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus", "l_quantity"]


def _observed(spark, d):
    return _read(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_quantity") % 4 != 0, F.col("l_quantity").cast("long") % 5))


def _old_new(spark, d):
    l = _read(spark, d, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_suppkey").alias("supp"))
    old, new = (l.where(F.col("l_linenumber") == k).select("l_orderkey", F.col("flag").alias(f"{n}_flag"), F.col("supp").alias(f"{n}_supp")) for k, n in ((1, "old"), (2, "new")))
    return old.join(new.hint("merge"), "l_orderkey", "left")


QUERIES = {
    "estimate_tokens": lambda s, d: _read(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", estimate_tokens(F.col("text"))).otherwise(0)).alias("tokens_out"), F.sum(F.when(F.col("role") != "assistant", estimate_tokens(F.col("text"))).otherwise(0)).alias("tokens_in"), F.sum(estimate_tokens(F.col("text"))).alias("tokens")),
    "context_window": lambda s, d: context_window(_read(s, d, "conversations"), 200),
    "modal_style": lambda s, d: modal_style(_observed(s, d), "l_orderkey", _ORDER, _ATTRIBUTES),
    "modal_style_defaults": lambda s, d: modal_style(_observed(s, d), "l_orderkey", _ORDER, _ATTRIBUTES, {"l_returnflag": "N", "l_quantity": "12"}),
    "sampled_modal_style": lambda s, d: sampled_modal_style(_observed(s, d), "l_orderkey", _ORDER, _ATTRIBUTES, 3),
    "first_match_style": lambda s, d: first_match_style(_observed(s, d), "l_orderkey", _ORDER, ["l_linestatus", "l_quantity"], F.col("l_returnflag") == "R"),
    "style_diff_columns": lambda s, d: style_diff(_old_new(s, d), ["flag", "supp"]).select("l_orderkey", "diff"),
    "rate_limit": lambda s, d: rate_limit(_read(s, d, "events"), 3, 86400).select("user_id", "event_id", "accepted"),
    "status_transition": lambda s, d: status_transition(_status_events(s, d)),
    "extract_tables": lambda s, d: extract_tables(html_tables(s, d)),
}

_OBS = "obs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CASE WHEN l_quantity % 4 <> 0 THEN CAST(l_quantity AS BIGINT) % 5 END AS l_quantity FROM lineitem)"
_MODAL = "l AS (SELECT *, UNNEST([{'a': 'l_returnflag', 'v': l_returnflag}, {'a': 'l_linestatus', 'v': l_linestatus}, {'a': 'l_quantity', 'v': CAST(l_quantity AS VARCHAR)}]) AS x FROM src), v AS (SELECT l_orderkey, x.a AS attribute, x.v AS value, count(*) AS votes, min((l_linenumber, l_partkey, l_suppkey)) AS f FROM l WHERE x.v IS NOT NULL GROUP BY ALL) SELECT l_orderkey, attribute, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, attribute ORDER BY votes DESC, f) AS r FROM v) WHERE r = 1"
_EV = "ev AS (SELECT user_id AS task, ts, event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' END AS status FROM events), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, event_id) AS k FROM ev)"
_EST = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 1.5 + 0.5) AS BIGINT)) END"

ORACLES = {
    "estimate_tokens": f"SELECT conv_id, CAST(coalesce(sum({_EST}) FILTER (role = 'assistant'), 0) AS BIGINT) AS tokens_out, CAST(coalesce(sum({_EST}) FILTER (role <> 'assistant'), 0) AS BIGINT) AS tokens_in, CAST(sum({_EST}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "context_window": "WITH s AS (SELECT conv_id, sum(length(text) // 2) FILTER (role = 'system') AS fixed FROM conversations GROUP BY 1), r AS (SELECT conv_id, turn, role, sum(length(text) // 2) OVER (PARTITION BY conv_id ORDER BY turn DESC) + coalesce(fixed, 0) AS used, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations JOIN s USING (conv_id) WHERE role <> 'system') SELECT conv_id, turn, role, CAST(used AS BIGINT) AS used, total - count(*) OVER (PARTITION BY conv_id) AS cut FROM r WHERE used <= 200",
    "modal_style": f"WITH {_OBS}, src AS (SELECT * FROM obs), {_MODAL}",
    "modal_style_defaults": f"WITH {_OBS}, src AS (SELECT * FROM obs), m AS (WITH {_MODAL}) SELECT * FROM m UNION ALL SELECT DISTINCT l_orderkey, 'l_quantity', '12', 0 FROM obs WHERE l_orderkey NOT IN (SELECT l_orderkey FROM m WHERE attribute = 'l_quantity')",
    "sampled_modal_style": f"WITH {_OBS}, src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM obs) WHERE rn <= 3), {_MODAL}",
    "first_match_style": f"WITH {_OBS}, f AS (SELECT l_orderkey, l_linestatus, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM obs WHERE l_returnflag = 'R') SELECT k.l_orderkey, l_linestatus, l_quantity FROM (SELECT DISTINCT l_orderkey FROM obs) k LEFT JOIN f ON f.l_orderkey = k.l_orderkey AND rn = 1",
    "style_diff_columns": "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL), j AS (SELECT a.l_orderkey, a.flag AS of, b.flag AS nf, a.supp AS os, b.supp AS ns FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = 2 WHERE a.l_linenumber = 1) SELECT l_orderkey, concat_ws('; ', CASE WHEN of IS DISTINCT FROM nf THEN 'flag: ' || coalesce(of, 'none') || ' → ' || coalesce(nf, 'none') END, CASE WHEN os IS DISTINCT FROM ns THEN 'supp: ' || coalesce(CAST(os AS VARCHAR), 'none') || ' → ' || coalesce(CAST(ns AS VARCHAR), 'none') END) AS diff FROM j",
    "rate_limit": "WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, event_id, k, true AS accepted, [ts] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, len(list_filter(r.kept, lambda t: o.ts - t < INTERVAL 24 HOUR)) < 3, CASE WHEN len(list_filter(r.kept, lambda t: o.ts - t < INTERVAL 24 HOUR)) < 3 THEN list_append(list_filter(r.kept, lambda t: o.ts - t < INTERVAL 24 HOUR), o.ts) ELSE r.kept END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, event_id, accepted FROM r",
    "status_transition": f"WITH RECURSIVE {_EV}, r AS (SELECT task, k, status, CASE WHEN status = 'completed' THEN ts END AS completed_at, 1 AS applied FROM o WHERE k = 1 UNION ALL SELECT o.task, o.k, CASE WHEN o.status = 'processing' AND r.status = 'cancelled' THEN r.status ELSE o.status END, CASE WHEN o.status = 'processing' AND r.status = 'cancelled' THEN r.completed_at WHEN o.status = 'completed' THEN coalesce(r.completed_at, o.ts) WHEN o.status IN ('pending', 'processing') THEN NULL ELSE r.completed_at END, r.applied + CASE WHEN o.status = 'processing' AND r.status = 'cancelled' THEN 0 ELSE 1 END FROM r JOIN o ON o.task = r.task AND o.k = r.k + 1) SELECT task, status, completed_at, CAST(applied AS BIGINT) AS applied FROM r QUALIFY row_number() OVER (PARTITION BY task ORDER BY k DESC) = 1",
    "extract_tables": r"WITH t AS (SELECT l_orderkey AS doc_id, string_agg('<tr><td>' || l_partkey || '</td><td>' || l_suppkey || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS rows, count(*) AS n FROM lineitem GROUP BY 1) SELECT doc_id, 0 AS table_idx, '<table border=1>' || rows || '</table>' AS table_html, n AS tr_open, n AS tr_close, 2 * n AS td_open, 2 * n AS td_close, true AS whole FROM t UNION ALL SELECT doc_id, 1, '<TABLE><tr><td>1</tr></TABLE>', 1, 1, 1, 0, false FROM t",
}
