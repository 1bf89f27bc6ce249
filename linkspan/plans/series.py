"""Time series over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import health, limits, rollup, series, timejoin
from ..operators.carry import carried
from ..sources.tables import scratch, table
from .registry import NOW, RUN, now, query, runs


@query("""SELECT start, event_type, n, floor(n / 300.0::DOUBLE * 60 * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS per_minute FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a minute in windows of five (O12.11)."""
    w = series.window_counts(table(spark, sf_dir, "events"), "ts", "5 minutes", ["event_type"], n=F.lit(True))
    return w.withColumn("per_minute", half_up(F.col("n") / 300.0 * 60, 4))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(CAST(30 * k AS INTEGER)) AS start, event_type FROM events, (SELECT unnest(range(0, 2)) AS k)), c AS (SELECT start, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM w GROUP BY 1)
SELECT start, errors, n, floor(errors / greatest(n, 1e-6::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS ratio FROM c""")
def error_ratio_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error ratio in sliding windows of an hour (O12.12, O12.14)."""
    w = series.window_counts(table(spark, sf_dir, "events"), "ts", "1 hour", slide="30 minutes", errors=F.col("event_type") == "error", n=F.lit(True))
    return w.withColumn("ratio", half_up(F.col("errors") / F.greatest(F.col("n"), F.lit(1e-6)), 6))


@query("""SELECT date_trunc('hour', ts) AS hour, floor(quantile_cont(value, 0.5) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS p50, floor(quantile_cont(value, 0.95) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS p95, floor(quantile_cont(value, 0.99) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS p99 FROM events GROUP BY 1""")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of each hour (O12.13)."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value")
    return series.quantiles(e, ["hour"], "value", p50=0.5, p95=0.95, p99=0.99)


_BUCKETS = (5.0, 10.0, 25.0, 50.0, float("inf"))


def _bucket_sql(q: float) -> str:
    return f"floor(min(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (total * {q}::DOUBLE - below) / (n - below) END) FILTER (WHERE n >= total * {q}::DOUBLE AND below < total * {q}::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


@query(f"""WITH b AS (SELECT unnest([5.0::DOUBLE, 10.0::DOUBLE, 25.0::DOUBLE, 50.0::DOUBLE, 'inf'::DOUBLE]) AS le), c AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY 1, 2),
w AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0.0::DOUBLE) AS low FROM c)
SELECT event_type, {_bucket_sql(0.5)} AS p50, {_bucket_sql(0.99)} AS p99 FROM w GROUP BY 1""")
def bucket_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from cumulative buckets, the last one without an end (O12.13)."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.explode(F.array(*map(F.lit, _BUCKETS))).alias("le"))
    c = e.groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("n"))
    return series.bucket_quantile(c, ["event_type"], "le", "n", 0.5, "p50").join(series.bucket_quantile(c, ["event_type"], "le", "n", 0.99, "p99"), "event_type")


@query("""WITH c AS (SELECT user_id, event_id, ts, event_id % 100 AS counter, lag(event_id % 100) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, CAST(sum(CASE WHEN b IS NULL THEN 0 WHEN counter < b THEN counter ELSE counter - b END) AS BIGINT) AS increase FROM c GROUP BY 1""")
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counters gained, restarts counted (O12.11)."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 100).alias("counter"))
    return series.increase(e, "user_id", "ts", "event_id", "counter").groupBy("user_id").agg(F.sum("gain").alias("increase"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1), f AS (SELECT *, lag(start) OVER (ORDER BY start) AS p FROM w WHERE errors >= 2),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR date_sub('second', p, start) > 3600 THEN 1 ELSE 0 END) OVER (ORDER BY start) AS island FROM f)
SELECT 'all' AS scope, min(start) AS since, max(start) + INTERVAL 1 HOUR AS until FROM g GROUP BY island HAVING date_sub('second', min(start), max(start) + INTERVAL 1 HOUR) >= 10800""")
def alert_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in which a condition held for three hours and more (O12.16)."""
    w = series.window_counts(table(spark, sf_dir, "events").withColumn("scope", F.lit("all")), "ts", "1 hour", ["scope"], errors=F.col("event_type") == "error")
    return health.alerts(w, "scope", "start", F.col("errors") >= 2, 3600, 10800)


@query(f"""WITH {RUN} SELECT source_id, date_sub('second', max(started_at) FILTER (WHERE status = 'completed'), TIMESTAMP '{NOW}') AS age FROM run WHERE started_at <= TIMESTAMP '{NOW}' GROUP BY 1""")
def success_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since each source's last success (O12.17)."""
    r = runs(spark, sf_dir).where(F.col("started_at") <= now())
    return r.groupBy("source_id").agg(F.timestamp_diff("SECOND", F.max(F.when(F.col("status") == "completed", F.col("started_at"))), now()).alias("age"))


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 50)""")
def unless_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector unless another has the key (O12.15)."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'error'").select("user_id").distinct().join(e.where("event_type = 'purchase' and value > 50").select("user_id"), "user_id", "left_anti")


def _numbered(window: str) -> str:
    """SQL that numbers the rows of s (key, ask) and folds each key's: f has i, held and fits."""
    return f"""f AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS held, true AS fits FROM s UNION ALL
  SELECT s.key, s.i, f.held + CASE WHEN f.held + s.ask <= {window} THEN s.ask ELSE 0 END, f.held + s.ask <= {window} FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)"""


@query(f"""WITH RECURSIVE r AS (SELECT event_id, ts, event_type <> 'view' AS remote, CAST(floor(value) AS BIGINT) AS tokens, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS user_count,
  count(*) OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS minute_count FROM events),
t AS (SELECT *, CASE WHEN user_count > 3 THEN 'user_limit' WHEN minute_count > 1 THEN 'rate_limit' END AS stop FROM r),
s AS MATERIALIZED (SELECT *, date_trunc('day', ts) AS key, CASE WHEN stop IS NULL AND remote THEN tokens ELSE 0 END AS ask, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS i FROM t),
{_numbered("2000")}
SELECT event_id, user_count, minute_count, coalesce(stop, CASE WHEN fits THEN 'admitted' ELSE 'budget' END) AS outcome, held AS reserved FROM s JOIN f USING (key, i)""")
def window_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under a daily limit of each user, a limit of each provider's minute and a daily budget of tokens, from which a refused one takes nothing (O12.5)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.floor("value").cast("long").alias("tokens"))
    out = limits.admissions(e, "user_id", "event_type", F.col("event_type") != "view", "ts", "event_id", "tokens", per_day=3, per_minute=1, budget=2000)
    return out.select("event_id", "user_count", "minute_count", "outcome", "reserved")


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT event_id, date_trunc('week', ts) AS key, CAST(floor(value) AS BIGINT) AS ask, row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts, event_id) AS i FROM events),
{_numbered("9000")} SELECT event_id, held AS reserved, fits FROM s JOIN f USING (key, i)""")
def weekly_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget a week for all requests together: keys too large for a fold, done by phases (O12.5)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.date_trunc("week", "ts").alias("week"), F.floor("value").cast("long").alias("tokens"))
    return limits.admitted(e, ["week"], "ts", "event_id", "tokens", 9000).select("event_id", "reserved", "fits")


@query("""WITH RECURSIVE r AS (SELECT event_id, {'provider': event_type <> 'view', 'minute': date_trunc('minute', ts)} AS key, CASE WHEN event_type = 'error' THEN -CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS ask, ts FROM events),
s AS MATERIALIZED (SELECT event_id, key, ask, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM r),
f AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS held, true AS fits FROM s UNION ALL
  SELECT s.key, s.i, CASE WHEN s.ask <= 0 OR f.held + s.ask <= 60 THEN greatest(f.held + s.ask, 0) ELSE f.held END, s.ask <= 0 OR f.held + s.ask <= 60 FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)
SELECT event_id, i AS requests, i <= 1 AS allowed, held AS reserved, fits FROM s JOIN f USING (key, i)""")
def minute_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each provider's minute, refused ones counted too, which are still allowed, and what is reserved of the minute's tokens, errors giving
    back what they took (O12.5)."""
    tokens = F.floor("value").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") != "view").alias("provider"), F.date_trunc("minute", "ts").alias("minute"), F.when(F.col("event_type") == "error", -tokens).otherwise(tokens).alias("tokens"))
    out = limits.reservations(e, ["provider", "minute"], "ts", "event_id", "tokens", 60)
    out = carried(out, ["provider", "minute"], F.date_trunc("second", "ts"), ["ts", "event_id"], {"requests": ("count", F.lit(1))})
    return out.select("event_id", "requests", (F.col("requests") <= 1).alias("allowed"), "reserved", "fits")


@query(f"""WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status, ts FROM events),
first AS (SELECT event_id FROM r WHERE status = 'pending' AND ts <= TIMESTAMP '{NOW}' - INTERVAL 2 MINUTE ORDER BY ts, event_id LIMIT 100)
SELECT event_id, CASE WHEN status = 'running' AND ts < TIMESTAMP '{NOW}' - INTERVAL 365 MINUTE THEN 'close' WHEN event_id IN (FROM first) THEN 'retry' ELSE 'none' END AS action FROM r""")
def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale runs to close, and the first pending ones that were never taken up, to try again (O12.3, O12.4)."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "pending").when(kind == "purchase", "completed").otherwise("running")
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("queued_at"), F.when(status != "pending", F.col("ts")).alias("started_at"))
    return health.settle_runs(r, now()).select(F.col("run_id").alias("event_id"), "action")


_TRIES = """a AS MATERIALIZED (SELECT event_id, user_id, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'purchase')),
start AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS n, NULL::TIMESTAMP AS expires, NULL::TIMESTAMP AS until, '' AS outcome FROM a)"""


def _tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases as failed and successful attempts."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))


@query(f"""WITH RECURSIVE {_TRIES}, f AS (FROM start UNION ALL SELECT user_id, i, CASE WHEN shut THEN 2 WHEN NOT failed THEN 0 ELSE live + 1 END, CASE WHEN shut THEN expires WHEN NOT failed THEN NULL WHEN live = 0 THEN ts + INTERVAL 3 DAY ELSE expires END,
  CASE WHEN shut THEN until WHEN failed AND live + 1 >= 2 THEN ts + INTERVAL 3 DAY END, CASE WHEN shut THEN 'refused' WHEN NOT failed THEN 'passed' WHEN live + 1 >= 2 THEN 'locked' ELSE 'failed' END
  FROM (SELECT a.*, f.expires, f.until, coalesce(f.until > a.ts, false) AS shut, CASE WHEN f.expires > a.ts THEN f.n ELSE 0 END AS live FROM f JOIN a ON a.user_id = f.user_id AND a.i = f.i + 1))
SELECT event_id, n AS failures, outcome, until AS locked_until FROM a JOIN f USING (user_id, i)""")
def attempt_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts under a counter that expires three days after its first failure; two lock for three days, in which all are refused (O12.6)."""
    out = limits.lockouts(_tries(spark, sf_dir), "user_id", "ts", "event_id", F.col("failed"), 2, 3 * 86400)
    return out.select("event_id", "failures", "outcome", "locked_until")


@query(f"""WITH RECURSIVE {_TRIES}, f AS (FROM start UNION ALL SELECT user_id, i, CASE WHEN NOT failed THEN 0 ELSE live + 1 END, CASE WHEN NOT failed THEN NULL WHEN live = 0 THEN ts + INTERVAL 2 DAY ELSE expires END,
  CASE WHEN failed AND live + 1 >= 2 THEN ts + INTERVAL 2 DAY WHEN failed AND until > ts THEN until END, CASE WHEN NOT failed THEN 'passed' WHEN live + 1 >= 2 THEN 'locked' ELSE 'failed' END
  FROM (SELECT a.*, f.expires, f.until, CASE WHEN f.expires > a.ts THEN f.n ELSE 0 END AS live FROM f JOIN a ON a.user_id = f.user_id AND a.i = f.i + 1))
SELECT event_id, n AS failures, outcome, until AS locked_until FROM a JOIN f USING (user_id, i)""")
def attempt_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare counter and its lock: attempts count at a locked key, too, and each failure at the limit or past it renews the lock (O12.6)."""
    out = limits.lockouts(_tries(spark, sf_dir), "user_id", "ts", "event_id", F.col("failed"), 2, 2 * 86400, guarded=False)
    return out.select("event_id", "failures", "outcome", "locked_until")


@query("""SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.value AS price FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last price before it (as-of join)."""
    e = table(spark, sf_dir, "events")
    prices = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("paid_at"), F.col("event_id").alias("purchase_id"), F.col("value").alias("price"))
    return timejoin.asof_join(e.select("event_id", "user_id", "ts"), prices, ["user_id"], "ts", "paid_at", ["purchase_id", "price"], right_order="purchase_id").drop("ts")


@query("""SELECT e.event_id, i.event_id AS incident_id FROM events e JOIN events i ON i.event_type = 'error' AND i.user_id = e.user_id AND e.ts >= i.ts AND e.ts < i.ts + to_minutes(CAST(floor(i.value * i.value) AS INTEGER)) WHERE e.event_type <> 'error'""")
def incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the incidents of its user that were open then, some short, some of months (interval join)."""
    e = table(spark, sf_dir, "events")
    until = F.timestamp_add("MINUTE", F.floor(F.col("value") * F.col("value")).cast("int"), F.col("ts"))
    incidents = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("incident_id"), F.col("ts").alias("since"), until.alias("until"))
    return timejoin.interval_join(e.where("event_type <> 'error'").select("event_id", "user_id", "ts"), incidents, ["user_id"], "ts", "since", "until").select("event_id", "incident_id")


_SCHED = f"""run AS (SELECT event_id AS run_id, user_id AS source_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'completed' ELSE 'running' END AS status FROM events
  WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR AND ts < TIMESTAMP '{NOW}')"""


@query(f"""WITH {_SCHED}, shut AS (SELECT source_id, run_id, 'close' AS action FROM run WHERE status = 'running' AND ts < TIMESTAMP '{NOW}' - INTERVAL 365 MINUTE),
again AS (SELECT source_id, run_id, 'retry' AS action FROM run WHERE status = 'pending' AND ts <= TIMESTAMP '{NOW}' - INTERVAL 2 MINUTE ORDER BY ts, run_id LIMIT 60),
busy AS (SELECT source_id FROM run WHERE status = 'pending' OR status = 'running' AND run_id NOT IN (SELECT run_id FROM shut)),
ready AS (SELECT user_id AS source_id, row_number() OVER (ORDER BY max(ts) + INTERVAL 1 HOUR, user_id) AS place FROM events WHERE ts < TIMESTAMP '{NOW}' GROUP BY 1 HAVING user_id % 4 <> 3 AND max(ts) + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}'),
go AS (SELECT source_id, NULL::BIGINT AS run_id, CASE WHEN source_id IN (FROM busy) THEN 'active_run' ELSE 'start' END AS action FROM ready WHERE place + (SELECT count(*) FROM again) <= 60)
FROM shut UNION ALL FROM again UNION ALL FROM go""")
def due_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tick of the scheduler: stale runs closed, pending ones sent again, due sources started or skipped (O12.2, O12.3, O12.4)."""
    e = table(spark, sf_dir, "events").where(F.col("ts") < now())
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "pending").when(kind.isin("purchase", "click"), "completed").otherwise("running")
    recent = e.where(F.col("ts") >= now() - F.expr("INTERVAL 12 HOURS"))
    r = recent.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("queued_at"), F.when(status != "pending", F.col("ts")).alias("started_at"))
    sources = e.groupBy(F.col("user_id").alias("source_id")).agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_at"))
    sources = sources.withColumns({"enabled": F.col("source_id") % 4 != 3, "automatic": F.lit(True), "has_config": F.lit(True)})
    return health.dispatch(sources, r, now(), 60)


@query("""SELECT date_trunc('day', ts) AS day, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS accepted, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-23') AS rejected FROM events GROUP BY 1""")
def late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows older than seven days at a fixed now are rejected (O12.18); the continuous form is in ``streaming``."""
    fresh = F.col("ts") >= now() - F.make_dt_interval(F.lit(7))
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count_if(fresh).alias("accepted"), F.count_if(~fresh).alias("rejected"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 SECOND, ts) - to_seconds(CAST(30 * k AS INTEGER)) AS start, event_type, value FROM events, (SELECT unnest(range(0, 10)) AS k))
SELECT start, count(*) AS requests, floor(count(*) / 300.0::DOUBLE * 60 * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS per_minute, floor(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1e-6::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS error_ratio, max(value) AS largest FROM w GROUP BY 1""")
def rules_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the last five minutes, every half minute, merged from states by half minutes that were stored in two runs (O12.14)."""
    e, path = table(spark, sf_dir, "events").select("ts", "event_type", "value"), scratch(spark, "rule-states")
    how = {"step": "30 seconds", "keys": [], "counts": {"all": F.lit(True), "errors": F.col("event_type") == "error"}, "sums": {"value": F.col("value")}}
    later = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    rollup.refresh(e.where(F.col("ts") < later), path, "ts", None, **how)
    rollup.refresh(e, path, "ts", later, **how)  # the day of the break is made anew
    w = rollup.merged(rollup.read(spark, path), [], "5 minutes", "30 seconds")
    ratio = half_up(F.col("count_errors") / F.greatest(F.col("count_all"), F.lit(1e-6)), 6)
    return w.select("start", F.col("count_all").alias("requests"), half_up(F.col("count_all") / 300.0 * 60, 4).alias("per_minute"), ratio.alias("error_ratio"), F.col("max_value").alias("largest"))


@query("""SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n, floor(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) / count(*) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS mean FROM events GROUP BY 1, 2""")
def weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks from states by hours, without the rows (O12.14)."""
    e = table(spark, sf_dir, "events").select("ts", "event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    hours = rollup.states(e, "ts", "1 hour", ["event_type"], {"all": F.lit(True)}, {"cents": F.col("cents")})
    weeks = rollup.merged(hours.withColumn("step", F.date_trunc("week", "step").cast("timestamp_ntz")), ["event_type"], "1 day")
    return weeks.select(F.col("start").alias("week"), "event_type", F.col("count_all").alias("n"), half_up(F.col("sum_cents") / F.col("count_all"), 4).alias("mean"))
