"""Versions, changes, timelines and revisions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import COOLDOWN_MINUTES, step
from ..operators import health, linkage, records
from ..sources.tables import table
from .registry import CANON, OCC, RUN, occurrences, query, runs


@query(f"""WITH {OCC}, w AS (SELECT *, CASE WHEN status = 'active' THEN row_number() OVER (PARTITION BY record_id ORDER BY scraped_at, occurrence_id) END AS rn,
  row_number() OVER (PARTITION BY record_id ORDER BY scraped_at, occurrence_id) AS seq FROM occ),
best AS (SELECT a.record_id, a.seq, a.scraped_at, (SELECT b.occurrence_id FROM w b WHERE b.record_id = a.record_id AND b.seq <= a.seq AND b.status = 'active'
  ORDER BY coalesce(b.page, 2147483647), b.priority, b.filled DESC, b.scraped_at DESC, b.occurrence_id DESC LIMIT 1) AS winner FROM w a),
l AS (SELECT *, lag(winner) OVER (PARTITION BY record_id ORDER BY seq) AS previous FROM best)
SELECT l.record_id, l.scraped_at, winner AS occurrence_id, previous, 'page=' || coalesce(CAST(o.page AS VARCHAR), 'none') || ', priority=' || o.priority || ', filled=' || o.filled || ', scraped_at=' || strftime(o.scraped_at, '%Y-%m-%d %H:%M:%S') AS reason
FROM l JOIN occ o ON o.occurrence_id = winner WHERE winner IS DISTINCT FROM previous""")
def canonical_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a record's canonical occurrence (O5.8)."""
    return records.canonical_history(occurrences(spark, sf_dir))


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_quantity, min(l_shipdate) OVER g AS first_seen, max(l_shipdate) OVER g AS last_seen,
  min(l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS page_so_far,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS revision
FROM lineitem WINDOW g AS (PARTITION BY l_partkey, l_suppkey)""")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time, the lowest page so far and a revision of each occurrence (O5.4, O5.6, O5.7)."""
    g = Window.partitionBy("l_partkey", "l_suppkey")
    o = g.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", F.min("l_shipdate").over(g).alias("first_seen"), F.max("l_shipdate").over(g).alias("last_seen"),
        F.min("l_linenumber").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("page_so_far"), F.row_number().over(o).alias("revision"),
    )


@query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER w AS rn, lag(coalesce(role, '')) OVER w AS r0, lag(coalesce(text, '')) OVER w AS t0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
d AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') <> r0 THEN 'role' END AS a, CASE WHEN coalesce(text, '') <> t0 THEN 'text' END AS b FROM c WHERE rn > 1)
SELECT conv_id, turn, concat_ws(',', a, b) AS changed, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS revision FROM d WHERE a IS NOT NULL OR b IS NOT NULL""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that differ from the one before, and in what (O5.5, O8.3)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = linkage.changed_fields(c, "conv_id", ["turn", "role", "text"], ["role", "text"])
    return out.select("conv_id", "turn", F.array_join("changed", ",").alias("changed"), "revision")


@query(f"""WITH {RUN}, n AS (SELECT source_id, run_id, row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS attempt, count(*) OVER (PARTITION BY source_id) AS total FROM run)
SELECT source_id, run_id, attempt, CAST(least(90, 5 + floor(attempt * 80.0::DOUBLE / total)) AS BIGINT) AS progress, total + 1 AS next_version FROM n""")
def attempt_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts in order, progress in percent and the next version (O4.22, O5.10, O5.11)."""
    r = health.numbered(runs(spark, sf_dir), "source_id", "started_at", "run_id")
    progress = F.least(F.lit(90), F.lit(5) + F.floor(F.col("attempt") * 80.0 / F.col("total"))).cast("long")
    return r.select("source_id", "run_id", "attempt", progress.alias("progress"), (F.col("total") + 1).alias("next_version"))


@query("""WITH r AS (SELECT o_custkey AS record_id, count(*) AS revision, max(o_orderkey) AS last_key FROM orders GROUP BY 1),
s AS (SELECT o_custkey AS record_id, count(*) AS revision FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT record_id, r.revision, coalesce(s.revision, 0) AS summary_revision FROM r LEFT JOIN s USING (record_id) WHERE coalesce(s.revision, 0) < r.revision""")
def stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose summary is older than their content (O5.9)."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("record_id"))
    old = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    return o.agg(F.count("*").alias("revision"), F.count_if(old).alias("summary_revision")).where("summary_revision < revision")


@query("""SELECT 'order-' || o_orderkey AS id, o_custkey AS record_id, 'order' AS kind, o_orderdate AS at FROM orders
UNION ALL SELECT 'event-' || event_id, user_id, 'event', ts FROM events
UNION ALL SELECT 'turn-' || conv_id || '-' || turn || '-' || length(text), conv_id, 'turn', TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)) FROM conversations
UNION ALL SELECT 'label-' || doc_id, doc_id, 'label', TIMESTAMP '2024-01-01' FROM labels""")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of events in one shape (O7.1)."""
    key = lambda kind, *parts: F.concat_ws("-", F.lit(kind), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    shape = lambda rows, id_, record, kind, at: rows.select(id_.alias("id"), F.col(record).alias("record_id"), F.lit(kind).alias("kind"), at.alias("at"))
    t = lambda name: table(spark, sf_dir, name)
    out = shape(t("orders"), key("order", "o_orderkey"), "o_custkey", "order", F.col("o_orderdate"))
    out = out.unionByName(shape(t("events"), key("event", "event_id"), "user_id", "event", F.col("ts")))
    turns = shape(t("conversations"), key("turn", "conv_id", "turn", F.length("text").cast("string")), "conv_id", "turn", start + F.make_dt_interval(mins=F.col("turn").cast("int")))
    return out.unionByName(turns).unionByName(shape(t("labels"), key("label", "doc_id"), "doc_id", "label", start))


@query(f"""WITH {OCC}, cut AS (SELECT *, scraped_at >= TIMESTAMP '1996-06-01' AS stays FROM occ), lost AS (SELECT DISTINCT record_id FROM cut WHERE NOT stays),
w AS (SELECT record_id, occurrence_id, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(page, 2147483647), priority, filled DESC, scraped_at DESC, occurrence_id DESC) AS rn FROM cut WHERE stays AND status = 'active')
SELECT l.record_id, (SELECT count(*) FROM cut c WHERE c.record_id = l.record_id AND c.stays) AS kept, (SELECT count(*) FROM cut c WHERE c.record_id = l.record_id AND NOT c.stays) AS removed, w.occurrence_id AS canonical_id
FROM lost l LEFT JOIN w ON w.record_id = l.record_id AND w.rn = 1""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cutoff keeps and removes, and the canonical occurrences chosen anew (O8.9, O8.10)."""
    cutoff, occ = datetime(1996, 6, 1), occurrences(spark, sf_dir)
    _, canon = records.retain(occ, cutoff)
    stays = F.col("scraped_at") >= F.lit(cutoff).cast("timestamp_ntz")
    counts = occ.groupBy("record_id").agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("removed")).where("removed > 0")
    return counts.join(canon.select("record_id", F.col("occurrence_id").alias("canonical_id")), "record_id", "left")


@query("""WITH gone AS (SELECT c_custkey, sha256(c_name) AS h FROM customer WHERE c_acctbal < 0), listed AS (SELECT sha256(c_name) AS h FROM customer WHERE c_acctbal < -900)
SELECT c_custkey AS record_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = c_custkey) AS lines, CASE WHEN h IN (FROM listed) THEN 'known' ELSE 'erasure' END AS suppression,
  (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)) AS orders_left, (SELECT count(DISTINCT h) FROM (SELECT h FROM gone UNION ALL FROM listed)) AS suppressed FROM gone""")
def erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that hang on erased records, their entry on the suppression list, written first, and what is left (O4.19, O8.11)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.sha2("c_name", 256).alias("key_hash"), "c_acctbal")
    keys = c.where("c_acctbal < 0").select("record_id", "key_hash")
    listed = c.where("c_acctbal < -900").select("key_hash", F.lit(3).cast("long").alias("blocked"), F.lit("known").alias("reason"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    counts = records.impact(keys.select("record_id"), {"orders": (orders, "o_custkey"), "lines": (lines, "o_custkey")})
    suppressed, left = records.erasure(keys, F.col("key_hash"), listed, {"orders": (orders, "o_custkey")})
    out = counts.join(keys, "record_id").join(suppressed.select("key_hash", F.col("reason").alias("suppression")), "key_hash").drop("key_hash")
    return out.withColumns({"orders_left": left["orders"].agg(F.count("*")).scalar(), "suppressed": suppressed.agg(F.count("*")).scalar()})


@query("""WITH e AS (SELECT *, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
f AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM e)
SELECT event_id, user_id, CAST(failures AS BIGINT) AS failures, CASE WHEN failed THEN ts + to_minutes(CAST(list_extract([5, 15, 30, 60], CAST(least(failures, 4) AS BIGINT)) AS INTEGER)) END AS cooldown_until FROM f""")
def cooldown_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure streaks and rests of endpoints (O12.7)."""
    out = health.cooldowns(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", "event_id")
    return out.select("event_id", "user_id", "failures", "cooldown_until")


@query("""SELECT event_id, n, CASE WHEN n >= 1 THEN list_extract([5, 15, 30, 60], least(n, 4)) END AS minutes, CASE WHEN n >= 1 THEN ts + to_minutes(CAST(list_extract([5, 15, 30, 60], least(n, 4)) AS INTEGER)) END AS next_at
FROM (SELECT event_id, ts, event_id % 7 AS n FROM events)""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next attempt by the number of failures (O10.10, O12.10)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 7).alias("n"))
    minutes = step(COOLDOWN_MINUTES, F.col("n"))
    return e.select("event_id", "n", minutes.alias("minutes"), F.timestamp_add("MINUTE", minutes, F.col("ts")).alias("next_at"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, first_flag, 'none') AS priority, n_lines FROM orders LEFT JOIN
(SELECT l_orderkey, min(l_returnflag) AS first_flag, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def backfill_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values filled from a joined table, and an ordered list of children (O8.13)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_returnflag").alias("first_flag"), F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("n_lines")  # an order's own lines
    )
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")), "first_flag", F.lit("none")).alias("priority"), "n_lines")


@query("""SELECT o_orderkey, to_json({'priority': o_orderpriority, 'lines': coalesce(l.lines, [])}) AS snapshot, to_json({'k': e.k}) AS kept FROM orders
LEFT JOIN (SELECT l_orderkey, list({'number': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey LEFT JOIN (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e ON e.event_id = o_orderkey WHERE e.k IS NOT NULL""")
def backfill_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object with the ordered list of its children's objects, and an object without one of its keys (O8.13)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part")))).alias("lines"))  # an order's own lines
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    snapshot = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)).alias("lines")))
    props = F.from_json(F.concat(F.substring_index("props", "}", 1), F.lit(', "old": [1]}')), "map<string,variant>")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey"), F.to_json(F.map_filter(props, lambda k, v: k != "old")).alias("kept"))
    return o.select("o_orderkey", snapshot.alias("snapshot")).join(e, "o_orderkey")
