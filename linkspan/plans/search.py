"""Record search, overviews, KPIs, source health and activity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import TimeRange, confidence_status, half_up, percentage, percentage_delta, range_problem, resolve_range
from ..functions.text import filled, humanise
from ..operators import health, linkage, records
from ..sources.tables import long_metrics, lookup, table
from .registry import CANON, NOW, OCC, RUN, now, occurrences, query, runs

_PCT = "CASE WHEN {w} > 0 THEN floor({p} * 100.0::DOUBLE / {w} * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE ELSE 0.0 END"
_DELTA = "CASE WHEN {b} > 0 THEN floor(({n} - {b}) * 100.0::DOUBLE / {b} * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE WHEN {n} > 0 THEN 100.0 ELSE 0.0 END"
_OVERVIEW = "SELECT record_id, count(*) AS occurrences, count(DISTINCT source) AS sources, min(scraped_at) AS first_seen, max(scraped_at) AS last_seen FROM occ GROUP BY record_id"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query(f"""WITH {OCC}, {CANON}, ov AS ({_OVERVIEW})
SELECT c_custkey AS record_id, c_name AS name, occurrences, sources, first_seen, last_seen, occurrence_id AS canonical_id, canon.source AS canonical_source,
  CASE WHEN confidence >= 0.85 THEN 'verified' ELSE 'unverified' END AS status
FROM customer JOIN ov ON record_id = c_custkey LEFT JOIN canon ON canon.record_id = c_custkey
WHERE (confidence < 0.85 OR confidence IS NULL) AND last_seen >= TIMESTAMP '1998-01-01' AND first_seen <= TIMESTAMP '1999-01-01'
ORDER BY last_seen DESC, c_custkey LIMIT 25""")
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a filtered, ordered page of records (O1.1, O2.4, O2.5, O3.2, O3.3, O3.5, O6.1, O10.9)."""
    found = records.search(_records(spark, sf_dir), occurrences(spark, sf_dir), "unverified", None, datetime(1998, 1, 1), datetime(1999, 1, 1))
    found = found.select("record_id", "name", "occurrences", "sources", "first_seen", "last_seen", "canonical_id", "canonical_source", confidence_status(F.col("confidence")).alias("status"))
    return records.page(found, 1, 25, F.col("last_seen").desc(), F.col("record_id").asc())


@query(f"""WITH {OCC}, ov AS ({_OVERVIEW}), hit AS (SELECT c_custkey AS record_id, occurrences, last_seen FROM customer JOIN ov ON record_id = c_custkey
  WHERE EXISTS (SELECT 1 FROM occ WHERE occ.record_id = c_custkey AND source = '1-URGENT'))
SELECT record_id, occurrences, last_seen, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY last_seen DESC, record_id LIMIT 25 OFFSET 50""")
def record_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the records with an occurrence at one source, with the total (O3.6, O6.2)."""
    found = records.search(_records(spark, sf_dir), occurrences(spark, sf_dir), source="1-URGENT").select("record_id", "occurrences", "last_seen")
    rows = records.page(found, 3, 25, F.col("last_seen").desc(), F.col("record_id").asc())
    return rows.withColumn("total", found.agg(F.count("*")).scalar())


@query(f"""WITH {OCC}, {CANON}, ov AS ({_OVERVIEW})
SELECT c_custkey AS record_id, coalesce(occurrences, 0) AS occurrences, coalesce(sources, 0) AS sources, first_seen, last_seen, floor(confidence * 100.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS confidence_pct
FROM customer LEFT JOIN ov ON record_id = c_custkey LEFT JOIN canon ON canon.record_id = c_custkey""")
def record_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overview of every record, those without occurrences too (O4.2, O10.8)."""
    occ = occurrences(spark, sf_dir)
    canon = records.canonical(occ).select("record_id", "confidence")
    out = _records(spark, sf_dir).join(records.overview(occ), "record_id", "left").join(canon, "record_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("occurrences", "sources")]
    return out.select("record_id", *zero, "first_seen", "last_seen", half_up(F.col("confidence") * 100.0, 1).alias("confidence_pct"))


@query(f"""WITH {OCC}, {CANON}
SELECT occ.occurrence_id, occ.record_id, n_name AS nation, coalesce(nullif(CASE WHEN occ.occurrence_id % 5 = 0 THEN '' ELSE occ.source END, ''), '(untitled)') AS title,
  canon.occurrence_id IS NOT NULL AS is_canonical
FROM occ JOIN customer ON c_custkey = occ.record_id JOIN nation ON n_nationkey = c_nationkey LEFT JOIN canon ON canon.occurrence_id = occ.occurrence_id""")
def occurrence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with their dimension and a canonical flag (O2.10, O2.11, O3.1)."""
    occ = occurrences(spark, sf_dir)
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    canon = records.canonical(occ).select("occurrence_id", F.lit(True).alias("c"))
    title = filled(F.when(F.col("occurrence_id") % 5 == 0, "").otherwise(F.col("source")), "(untitled)")
    out = occ.join(who, "record_id").join(nation, "c_nationkey").join(canon, "occurrence_id", "left")
    return out.select("occurrence_id", "record_id", "nation", title.alias("title"), F.col("c").isNotNull().alias("is_canonical"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram under an IN list (O2.6, O4.5)."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '{NOW}') AS runs,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-23') AS runs_before,
  count(*) FILTER (WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '{NOW}') AS errors,
  count(*) FILTER (WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-23') AS errors_before,
  count(*) FILTER (WHERE ts >= date_trunc('day', TIMESTAMP '{NOW}')) AS runs_today FROM events WHERE ts >= TIMESTAMP '2024-01-16')
SELECT runs, runs_before, runs_today, errors, errors - errors_before AS errors_delta, {_PCT.format(p='errors', w='runs')} AS error_pct, {_DELTA.format(n='runs', b='runs_before')} AS runs_delta_pct FROM k""")
def kpi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All KPIs of a range, the one before and today, in one scan (O2.1, O2.3, O4.1, O4.7, O4.8, O4.9, O10.3)."""
    end = datetime.fromisoformat(NOW)
    span = resolve_range(datetime(2024, 1, 23), end, end)
    today = F.date_trunc("day", now()).cast("timestamp_ntz")
    ts, error = F.col("ts"), F.col("event_type") == "error"
    e = table(spark, sf_dir, "events").where(ts >= F.lit(span.before.start).cast("timestamp_ntz"))
    k = e.agg(
        F.count_if(span.holds(ts)).alias("runs"), F.count_if(span.before.holds(ts)).alias("runs_before"),
        F.count_if(error & span.holds(ts)).alias("errors"), F.count_if(error & span.before.holds(ts)).alias("errors_before"),
        F.count_if(ts >= today).alias("runs_today"),
    )
    c = F.col
    return k.select("runs", "runs_before", "runs_today", "errors", (c("errors") - c("errors_before")).alias("errors_delta"), percentage(c("errors"), c("runs")).alias("error_pct"), percentage_delta(c("runs"), c("runs_before")).alias("runs_delta_pct"))


@query(f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts - to_days(CAST(event_id % 100 AS INTEGER)) END AS s,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ts - INTERVAL 200 DAY ELSE ts END AS e FROM events)
SELECT event_id, CASE WHEN s IS NULL AND e IS NULL THEN 'valid' WHEN s IS NULL OR e IS NULL THEN 'one bound' WHEN s >= e THEN 'reversed' WHEN e > TIMESTAMP '{NOW}' THEN 'future'
  WHEN date_sub('second', s, e) > 90 * 86400 THEN 'too long' ELSE 'valid' END AS problem FROM r""")
def range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time ranges by what is wrong with them (O2.2)."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    start = F.when(i % 5 != 0, F.col("ts") - F.make_dt_interval((i % 100).cast("int")))
    end = F.when(i % 7 == 0, None).when(i % 11 == 0, F.col("ts") - F.expr("INTERVAL 200 DAY")).otherwise(F.col("ts"))
    rows = e.select("event_id", start.alias("s"), end.alias("e"))
    return rows.select("event_id", range_problem(F.col("s"), F.col("e"), now()).alias("problem"))


@query(f"""WITH {RUN}, rates AS (SELECT source_id, sum(items) AS items, count(*) FILTER (WHERE status = 'failed') AS errors FROM run
  WHERE started_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND started_at < TIMESTAMP '{NOW}' GROUP BY 1),
last10 AS (SELECT source_id, status, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(CASE WHEN event_type <> 'view' THEN started_at + to_minutes(CAST(items AS INTEGER)) END, started_at) DESC, run_id DESC) AS rn FROM run),
s AS (SELECT source_id, count(*) AS streak FROM (SELECT source_id, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY rn) AS m FROM last10 WHERE rn <= 10) WHERE m = 0 GROUP BY 1)
SELECT source_id, CAST(items AS BIGINT) AS items, errors, CASE WHEN items + errors > 0 THEN floor(errors / (items + errors) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE ELSE 0.0 END AS error_rate,
  coalesce(streak, 0) AS streak, coalesce(streak, 0) >= 3 AS alert FROM rates LEFT JOIN s USING (source_id)""")
def source_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, errors, rate and the streak within the last ten runs of each source, by the time a run started or else was queued (O4.4, O4.10, O5.2, O6.6)."""
    r = runs(spark, sf_dir)
    # Runs are queued when their event comes and start some minutes later; views never do.
    began = F.when(F.col("event_type") != "view", F.timestamp_add("MINUTE", F.col("items").cast("int"), F.col("started_at")))
    queued = r.withColumn("queued_at", F.col("started_at")).withColumn("at", F.coalesce(began, "queued_at"))
    streak = health.leading_streak(queued, "source_id", F.col("status") == "failed", ["at", "run_id"], most=10)
    return health.day_rates(r, now()).join(streak, "source_id", "left").withColumn("alert", F.col("streak") >= 3)


_SNAP = f"""{RUN}, seen AS (SELECT * FROM run WHERE started_at <= TIMESTAMP '{NOW}'),
c AS (SELECT source_id, count(*) FILTER (WHERE status = 'failed' AND started_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS failed_24h,
  count(*) FILTER (WHERE status = 'completed' AND started_at >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS completed_24h,
  count(*) FILTER (WHERE status = 'failed' AND started_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS failed_7d,
  count(*) FILTER (WHERE status = 'completed' AND started_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS completed_7d,
  CAST(sum(CASE WHEN status = 'completed' AND started_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN items ELSE 0 END) AS BIGINT) AS items_7d,
  arg_max(status, (started_at, run_id)) AS last_status, max(started_at) AS last_run, max(started_at) FILTER (WHERE status = 'completed') AS last_success FROM seen GROUP BY 1),
k AS (SELECT source_id, count(*) AS failures_in_a_row FROM (SELECT source_id, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS m FROM seen) WHERE m = 0 GROUP BY 1),
src AS (SELECT DISTINCT user_id % 12 AS source_id FROM events),
snap AS (SELECT source_id, last_status, last_run, last_success, coalesce(failed_24h, 0) AS failed_24h, coalesce(completed_24h, 0) AS completed_24h, coalesce(failed_7d, 0) AS failed_7d,
  coalesce(completed_7d, 0) AS completed_7d, coalesce(items_7d, 0) AS items_7d, coalesce(failures_in_a_row, 0) AS failures_in_a_row,
  CASE WHEN last_status = 'running' THEN greatest(0, date_sub('second', last_run, TIMESTAMP '{NOW}')) END AS running_seconds FROM src LEFT JOIN c USING (source_id) LEFT JOIN k USING (source_id))"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("source_id")).distinct()  # two of them never run
    return health.snapshot(sources, runs(spark, sf_dir), now())


@query(f"WITH {_SNAP} SELECT * FROM snap")
def source_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of every source, those without runs too (O4.11, O5.12)."""
    return _snapshot(spark, sf_dir)


@query(f"""WITH {_SNAP} SELECT source_id, 'failed_24h' AS metric, CAST(failed_24h AS DOUBLE) AS value FROM snap UNION ALL SELECT source_id, 'items_7d', CAST(items_7d AS DOUBLE) FROM snap
UNION ALL SELECT source_id, 'failures_in_a_row', CAST(failures_in_a_row AS DOUBLE) FROM snap""")
def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot as a long table of metrics (O1.19)."""
    return long_metrics(_snapshot(spark, sf_dir), "source_id", ["failed_24h", "items_7d", "failures_in_a_row"])


@query(f"""WITH {_SNAP}, h AS (SELECT source_id, CASE WHEN last_status IS NULL THEN 'offline' WHEN failures_in_a_row > 0 THEN 'degraded' ELSE 'healthy' END AS state FROM snap)
SELECT count(*) AS total, count(*) FILTER (WHERE state = 'healthy') AS healthy, count(*) FILTER (WHERE state = 'degraded') AS degraded, count(*) FILTER (WHERE state = 'offline') AS offline,
  CASE WHEN count(*) FILTER (WHERE state <> 'healthy') = 0 THEN 'healthy' WHEN count(*) FILTER (WHERE state <> 'healthy') = count(*) THEN 'unavailable' ELSE 'degraded' END AS overall,
  {_PCT.format(p="count(*) FILTER (WHERE state = 'healthy')", w='count(*)')} AS healthy_pct FROM h""")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by state, the worst-of status and a share (O4.5, O4.24, O4.25)."""
    state = F.when(F.col("last_status").isNull(), "offline").when(F.col("failures_in_a_row") > 0, "degraded").otherwise("healthy")
    h = _snapshot(spark, sf_dir).select(state.alias("state"))
    out = h.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("healthy", "degraded", "offline")])
    bad = F.col("total") - F.col("healthy")
    overall = F.when(bad == 0, "healthy").when(bad == F.col("total"), "unavailable").otherwise("degraded")
    return out.withColumns({"overall": overall, "healthy_pct": percentage(F.col("healthy"), F.col("total"))})


@query("""SELECT user_id, count(*) FILTER (WHERE m = 0) AS streak FROM (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS m FROM events) GROUP BY 1""")
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unbounded failure streak of every user (O5.1)."""
    return health.leading_streak(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", ["ts", "event_id"])


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user (O5.3)."""
    return health.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id")


@query(f"""WITH {OCC}, {CANON} SELECT record_id, occurrence_id, source, scraped_at, page, filled FROM canon""")
def canonical_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical occurrence of every record that has an active one (O4.12, O4.13)."""
    return records.canonical(occurrences(spark, sf_dir)).select("record_id", "occurrence_id", "source", "scraped_at", "page", "filled")


@query(f"""WITH {OCC}, aff AS (SELECT * FROM occ WHERE record_id IN (SELECT record_id FROM occ WHERE source = '5-LOW')),
w AS (SELECT record_id, occurrence_id, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(page, 2147483647), priority, filled DESC, scraped_at DESC, occurrence_id DESC) AS a,
  row_number() OVER (PARTITION BY record_id ORDER BY coalesce(page, 2147483647), CASE WHEN source = '5-LOW' THEN 0 ELSE priority END, filled DESC, scraped_at DESC, occurrence_id DESC) AS b FROM aff WHERE status = 'active')
SELECT (SELECT count(DISTINCT record_id) FROM aff) AS records, (SELECT count(*) FROM w WHERE a = 1 AND b <> 1) AS changed""")
def source_priority_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a higher priority of one source changes (O4.3, O8.12)."""
    return records.priority_impact(occurrences(spark, sf_dir), "5-LOW", 0)


@query(f"""WITH {RUN} SELECT source_id, date_trunc('day', started_at) AS day, count(*) AS runs, CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'completed') AS completed, greatest(count(DISTINCT user_id) - 1, 0) AS rotations FROM run GROUP BY 1, 2""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by source and day (O4.21)."""
    r = runs(spark, sf_dir).groupBy("source_id", F.date_trunc("day", "started_at").cast("timestamp_ntz").alias("day"))
    return r.agg(
        F.count("*").alias("runs"), F.sum("items").alias("items"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "completed").alias("completed"), F.greatest(F.count_distinct("user_id") - 1, F.lit(0)).alias("rotations"),
    )


@query("""SELECT event_id, ts, upper(substr(a, 1, 1)) || lower(substr(a, 2)) || ' (' || substr(CAST(event_id AS VARCHAR), 1, 8) || ')' AS message FROM
(SELECT *, trim(replace('source_' || event_type, '_', ' ')) AS a, CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 'all' WHEN 1 THEN 'operator' ELSE 'admin' END AS audience FROM events)
WHERE (audience IN ('operator', 'all') OR user_id = 7) AND event_type LIKE '%r%' AND ts < DATE '2024-01-29' + 1 ORDER BY ts DESC, event_id DESC LIMIT 20""")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an operator may see of the last activity (O2.9, O2.14, O6.1, O9.18, O9.19)."""
    audience = F.when(F.col("event_id") % 3 == 0, "all").when(F.col("event_id") % 3 == 1, "operator").otherwise("admin")
    e = table(spark, sf_dir, "events").withColumn("audience", audience)
    e = e.where(F.col("audience").isin("operator", "all") | (F.col("user_id") == 7))
    e = e.where(F.lower("event_type").contains("r") & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz")))
    message = humanise(F.concat(F.lit("source_"), F.col("event_type")), F.col("event_id").cast("string"))
    return e.select("event_id", "ts", message.alias("message")).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20)


@query("""WITH n AS (SELECT event_id, user_id % 5 AS me FROM events WHERE event_type = 'signup'), r AS (SELECT event_id, user_id % 5 AS me FROM events WHERE event_type = 'signup' AND event_id % 3 = 0)
SELECT n.me AS user_id, count(*) AS notifications, count(*) FILTER (WHERE r.event_id IS NULL) AS unread FROM n LEFT JOIN r ON r.event_id = n.event_id AND r.me = n.me GROUP BY 1""")
def notifications_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All and unread notifications of each user (O3.4, O3.7)."""
    n = table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", (F.col("user_id") % 5).alias("user_id"))
    read = n.where("event_id % 3 = 0").select("event_id", "user_id", F.lit(True).alias("read"))
    return n.join(read, ["event_id", "user_id"], "left").groupBy("user_id").agg(F.count("*").alias("notifications"), F.count_if(F.col("read").isNull()).alias("unread"))


@query("""SELECT DISTINCT s_suppkey AS endpoint_id FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND s_suppkey % 4 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey
WHERE s_acctbal > 0 AND (s_suppkey % 4 = 0 OR r_name = 'EUROPE')""")
def endpoint_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints for one source: those for all sources, and those bound to it through a bridge (O1.18, O3.8, O7.5)."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    bridge = s.where("s_suppkey % 4 <> 0").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    scope = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey")
    bound = bridge.join(scope, "n_nationkey").select(F.col("s_suppkey").alias("endpoint_id"))
    return s.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("endpoint_id")).unionByName(bound).distinct()


@query("""SELECT l.doc_id, d.source, l.quality, l.toxic, c_name AS reviewer FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN customer ON c_custkey = l.doc_id AND l.toxic = 1""")
def class_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of three joins, the last one optional (O3.9)."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("toxic"), F.col("c_name").alias("reviewer"))
    return l.join(d, "doc_id").join(who, ["doc_id", "toxic"], "left").select("doc_id", "source", "quality", "toxic", "reviewer")


@query(f"""WITH {RUN}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM run), top AS (SELECT * FROM r WHERE rn <= 50),
e AS (SELECT event_id AS run_id, count(*) AS n_errors, min(code) AS first_code FROM (SELECT event_id, 'E' || CAST(event_id % 4 AS VARCHAR) AS code FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'E9' FROM events WHERE event_type = 'error' AND event_id % 2 = 0) GROUP BY 1)
SELECT source_id, run_id, coalesce(n_errors, 0) AS n_errors, first_code FROM top LEFT JOIN e USING (run_id)""")
def runs_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty runs of each source with their errors as a nested list, flattened (O3.10)."""
    r = runs(spark, sf_dir)
    w = Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    top = r.withColumn("rn", F.row_number().over(w)).where("rn <= 50")
    bad = r.where("status = 'failed'")
    codes = bad.select("run_id", F.concat(F.lit("E"), (F.col("run_id") % 4).cast("string")).alias("code")).unionByName(bad.where("run_id % 2 = 0").select("run_id", F.lit("E9").alias("code")))
    nested = codes.groupBy("run_id").agg(F.array_sort(F.collect_list("code")).alias("errors"))  # a run's own errors
    out = top.join(nested, "run_id", "left")
    return out.select("source_id", "run_id", F.coalesce(F.size("errors"), F.lit(0)).cast("long").alias("n_errors"), F.get("errors", F.lit(0)).alias("first_code"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup (O1.1)."""
    return lookup(table(spark, sf_dir, "customer"), "c_custkey", 42).select("c_custkey", "c_name")


@query("SELECT c_custkey AS \"cCustkey\", c_name AS \"cName\", c_mktsegment AS \"cMktsegment\" FROM customer")
def camel_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names in camel case (O2.12)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    camel = lambda n: n.split("_")[0] + "".join(x.title() for x in n.split("_")[1:])
    return c.select(*[F.col(n).alias(camel(n)) for n in c.columns])


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_nationkey = 3 DESC, lower(c_mktsegment), c_custkey LIMIT 1000")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded batch in a total order of three keys (O6.4, O6.5)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return c.orderBy((F.col("c_nationkey") == 3).desc(), F.lower("c_mktsegment"), "c_custkey").limit(1000)


@query(f"""WITH ep AS (SELECT s_suppkey AS id, s_acctbal > 0 AS enabled, CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE END AS cooldown_until,
  CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '{NOW}' - to_hours(CAST(s_suppkey % 50 AS INTEGER)) END AS last_used_at FROM supplier)
SELECT id, last_used_at, count(*) OVER () AS healthy FROM ep WHERE enabled AND (cooldown_until IS NULL OR cooldown_until <= TIMESTAMP '{NOW}') ORDER BY last_used_at ASC NULLS FIRST, id LIMIT 10""")
def health_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten healthy endpoints that rested longest, never used ones first (O2.8, O4.20, O6.3, O12.8)."""
    k = F.col("s_suppkey")
    ep = table(spark, sf_dir, "supplier").select(
        k.alias("id"), (F.col("s_acctbal") > 0).alias("enabled"), F.when(k % 3 == 0, now() + F.expr("INTERVAL 5 MINUTE")).alias("cooldown_until"),
        F.when(k % 4 != 0, now() - F.make_dt_interval(hours=(k % 50).cast("int"))).alias("last_used_at"),
    )
    healthy = ep.where(F.col("enabled") & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now())))
    first = healthy.select("id", "last_used_at").orderBy(F.col("last_used_at").asc_nulls_first(), "id").limit(10)
    return first.withColumn("healthy", healthy.agg(F.count("*")).scalar())


@query("SELECT 'F' AS status WHERE false")
def flagged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that nothing meets folds to an empty relation (O2.5)."""
    return table(spark, sf_dir, "orders").where(records.status_filter("flagged", F.lit(1.0))).select(F.col("o_orderstatus").alias("status"))
