"""Runs, streaks, snapshots and scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import COOLDOWN_MINUTES, half_up, step
from .carry import carried


def leading_streak(rows: DataFrame, key: str, hit: Column, order: list[str], most: int | None = None, name: str = "streak") -> DataFrame:
    """How many of a key's rows, from the last one in ``order`` back, are hits without a break (O5.1); of the last ``most`` rows if given (O5.2).

    Rows without a value in ``order`` come first. These are the rows after the last miss: two aggregations that combine in each task, so that a key with a
    third of all rows needs no window over them. The last ``most`` rows are limited in each task first.
    """
    rows = rows.select(key, hit.alias("hit"), F.struct(*order).alias("at"))
    if most is not None:
        last = Window.partitionBy(key).orderBy(F.col("at").desc())
        rows = rows.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= most).drop("rn")
    miss = rows.groupBy(key).agg(F.max(F.when(~F.col("hit"), F.col("at"))).alias("miss"))
    after = F.col("miss").isNull() | (F.col("at") > F.col("miss"))
    return rows.join(miss, key).groupBy(key).agg(F.count_if(after).alias(name))


def numbered(rows: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """``rows`` with attempt (1, 2, ... by time within a key) and total (rows of the key) (O4.22, O5.10).

    Rows are numbered within a key's day and days are added up before, so a large key is sorted in parts.
    """
    rows = rows.withColumn("day", F.to_date(ts))
    days = rows.groupBy(key, "day").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("n").over(whole.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(key, "day", before.alias("before"), F.sum("n").over(whole).alias("total"))
    inside = F.row_number().over(Window.partitionBy(key, "day").orderBy(ts, order))
    return rows.join(days, [key, "day"]).withColumn("attempt", (F.col("before") + inside)).drop("before", "day")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns (O5.3)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def snapshot(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Counts of a day and a week, last status and success, streak and running time of every source (O4.11).

    Sources without runs have zeros. Runs without a start don't count.
    """
    runs = runs.where(F.col("started_at").isNotNull() & (F.col("started_at") <= now))
    day, week = (F.col("started_at") >= now - F.expr(f"INTERVAL {d} DAY") for d in (1, 7))
    done = F.col("status") == "completed"
    counts = runs.groupBy("source_id").agg(
        F.count_if(day & (F.col("status") == "failed")).alias("failed_24h"),
        F.count_if(day & done).alias("completed_24h"),
        F.count_if(week & (F.col("status") == "failed")).alias("failed_7d"),
        F.count_if(week & done).alias("completed_7d"),
        F.sum(F.when(week & done, F.col("items")).otherwise(0)).alias("items_7d"),
        F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"),
        F.max("started_at").alias("last_run"),
        F.max(F.when(done, F.col("started_at"))).alias("last_success"),
    )
    streak = leading_streak(runs, "source_id", F.col("status") == "failed", ["started_at", "run_id"], name="failures_in_a_row")
    out = sources.select("source_id").join(counts, "source_id", "left").join(streak, "source_id", "left")
    zero = [c for c in out.columns if c.endswith(("_24h", "_7d", "_row"))]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero})
    running = F.timestamp_diff("SECOND", F.col("last_run"), now)
    return out.withColumn("running_seconds", F.when(F.col("last_status") == "running", F.greatest(F.lit(0), running)).cast("long"))


def day_rates(runs: DataFrame, now: Column) -> DataFrame:
    """Items, errors and error rate of each source's last day (O4.10); errors are also among the items."""
    inside = runs.where((F.col("started_at") >= now - F.expr("INTERVAL 1 DAY")) & (F.col("started_at") < now))
    sums = inside.groupBy("source_id").agg(F.sum("items").alias("items"), F.count_if(F.col("status") == "failed").alias("errors"))
    total = F.col("items") + F.col("errors")
    return sums.withColumn("error_rate", F.when(total > 0, half_up(F.col("errors") / F.nullif(total, F.lit(0)), 4)).otherwise(0.0))


def cooldowns(attempts: DataFrame, key: str, ts: str, failed: Column, order: str) -> DataFrame:
    """Failures in a row up to each attempt, and until when the endpoint then rests (O12.7).

    A success ends a streak. Failures are summed within days, and a streak that a day leaves open goes on in the next ones,
    in one pass over the rows. The continuous form is in ``streaming``.
    """
    rows = attempts.withColumns({"failed": F.coalesce(failed, F.lit(False)), "cool_day": F.date_trunc("day", ts)})
    inside = Window.partitionBy(key, "cool_day").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"cool_sum": F.count_if(F.col("failed")).over(inside), "cool_passed": F.max(F.when(~F.col("failed"), F.struct(ts, order))).over(inside)})
    rows = rows.withColumn("cool_base", F.coalesce(F.max(F.when(~F.col("failed"), F.col("cool_sum"))).over(inside), F.lit(0)))
    rows = rows.withColumn("cool_streak", F.col("cool_sum") - F.col("cool_base"))
    last = F.max_by(F.struct(F.col("cool_streak").alias("streak"), F.col("cool_passed").isNotNull().alias("passed")), F.struct(ts, order))
    days = rows.groupBy(key, "cool_day").agg(last.alias("of"))
    # A day without a success adds its failures to the open streak, one with a success begins it anew.
    before = Window.partitionBy(key).orderBy("cool_day")
    days = days.withColumn("cool_run", F.count_if(F.col("of.passed")).over(before))
    days = days.withColumn("cool_open", F.sum("of.streak").over(Window.partitionBy(key, "cool_run").orderBy("cool_day")))
    days = days.select(F.col(key).alias("cool_key"), F.col("cool_day").alias("cool_on"), F.coalesce(F.lag("cool_open").over(before), F.lit(0)).alias("carried"))
    rows = rows.join(days, F.col(key).eqNullSafe(F.col("cool_key")) & F.col("cool_day").eqNullSafe(F.col("cool_on")), "left")
    failures = F.col("cool_streak") + F.when(F.col("cool_passed").isNull(), F.col("carried")).otherwise(0)
    until = F.timestamp_add("MINUTE", step(COOLDOWN_MINUTES, F.col("failures")), F.col(ts))
    rows = rows.withColumn("failures", failures).withColumn("cooldown_until", F.when(F.col("failed"), until))
    return rows.select(*attempts.columns, "failed", "failures", "cooldown_until")


def alerts(windows: DataFrame, key: str, at: str, firing: Column, step_seconds: int, hold_seconds: int) -> DataFrame:
    """Runs of adjoining windows in which a condition holds for ``hold_seconds`` at least (O12.16): key, since, until."""
    w = Window.partitionBy(key).orderBy(at)
    rows = windows.where(firing).withColumn("gap", F.coalesce(F.timestamp_diff("SECOND", F.lag(at).over(w), F.col(at)) > step_seconds, F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("gap").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy(key, "island").agg(F.min(at).alias("since"), F.timestamp_add("SECOND", F.lit(step_seconds), F.max(at)).alias("until"))
    return spans.where(F.timestamp_diff("SECOND", F.col("since"), F.col("until")) >= hold_seconds).drop("island")


def settle_runs(runs: DataFrame, now: Column, batch: int = 100, longest: str = "6 HOURS 5 MINUTES", patience: str = "2 MINUTES") -> DataFrame:
    """``runs`` (run_id, status, queued_at, started_at) with action (O12.3, O12.4): ``close`` for running ones that started
    longer than ``longest`` ago, ``retry`` for the first ``batch`` pending ones, by their time, that were queued ``patience`` ago or
    longer and that nobody took up, else ``none``."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {longest}"))
    stuck = (F.col("status") == "pending") & (F.col("queued_at") <= now - F.expr(f"INTERVAL {patience}"))
    retried = runs.where(stuck).orderBy("queued_at", "run_id").limit(batch).select(F.col("run_id").alias("retry_id"))
    out = runs.join(F.broadcast(retried), F.col("run_id") == F.col("retry_id"), "left")
    return out.withColumn("action", F.when(stale, "close").when(F.col("retry_id").isNotNull(), "retry").otherwise("none")).drop("retry_id")


def dispatch(sources: DataFrame, runs: DataFrame, now: Column, batch: int = 100, longest: str = "6 HOURS 5 MINUTES", patience: str = "2 MINUTES") -> DataFrame:
    """What a tick of the scheduler does (O12.3): source_id, run_id and action.

    Stale runs are closed (``close``), stuck pending ones sent again (``retry``). What these leave of ``batch`` goes to due
    sources, the earliest first: enabled, automatic, configured, next_at not after ``now``. One of them that has a pending run or
    a running one, closed ones apart, is skipped (``active_run``) but uses its place up; the others start (``start``).
    """
    settled = settle_runs(runs, now, batch, longest, patience)
    retried = settled.where("action = 'retry'").agg(F.count("*").alias("n")).scalar()
    acted = settled.where("action <> 'none'").select("source_id", "run_id", "action")
    active = settled.where("status = 'pending' or status = 'running' and action <> 'close'").select(F.col("source_id").alias("busy")).distinct()
    ready = sources.where(F.col("enabled") & F.col("automatic") & F.col("has_config") & (F.col("next_at") <= now))
    first = ready.orderBy("next_at", "source_id").limit(batch).withColumn("place", F.row_number().over(Window.orderBy("next_at", "source_id")))  # a batch at most
    first = first.where(F.col("place") + retried <= batch)
    started = first.join(active, F.col("source_id") == F.col("busy"), "left").select("source_id", F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"), F.when(F.col("busy").isNotNull(), "active_run").otherwise("start").alias("action"))
    return acted.unionByName(started)
