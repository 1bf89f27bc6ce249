"""Limits on requests and attempts: counters that expire, budgets that a refusal doesn't touch, locks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import broadcast_if_few, stored
from .carry import carried
from .timejoin import asof_join

#: Rows of a key that are folded one after the other; larger keys are done in phases.
FOLD = 2000


def admitted(rows: DataFrame, keys: list[str], ts: str, order: str, amount: str, most: int, bucket: str = "hour", fold: int = FOLD) -> DataFrame:
    """``rows`` with fits (does the amount fit below ``most`` beside what its key has reserved so far?) and reserved (what the
    key has reserved after the row) (O12.5). A row that doesn't fit leaves no trace, so smaller ones after it may fit.

    Amounts are whole numbers; null, zero and negative ones fit and reserve nothing. (ts, order) tells all rows of a key apart.

    That is no prefix sum, but it becomes some: with ``c`` left, rows beyond ``c`` never fit again. Of the others, call those up
    to ``c / 2`` small. Small ones fit until they come to more than ``c / 2``, and the one that goes beyond fits as well;
    of the larger ones only one that fits beside the small ones before it. Whichever comes first ends a phase and leaves half of
    ``c`` at most, so a key has no more phases than its budget has bits. A phase is a prefix sum over buckets, so a key with a
    third of all rows is worked on in parts. Keys of up to ``fold`` rows are folded row by row.
    """
    rows = rows.withColumns({"adm_key": F.struct(*keys), "adm_size": F.greatest(F.coalesce(F.col(amount), F.lit(0)), F.lit(0)).cast("long"), "adm_at": F.struct(F.col(ts), F.col(order))})
    rows = stored(rows, "requests")
    asks = rows.where("adm_size > 0")
    large = stored(asks.groupBy("adm_key").agg(F.count("*").alias("n")).where(F.col("n") > fold).select("adm_key"), "large-keys")
    known = broadcast_if_few(large)
    fits = [_folded(asks.join(known, "adm_key", "left_anti").select("adm_key", "adm_at", "adm_size"), most)]
    if not large.isEmpty():
        big = stored(asks.join(known, "adm_key", "left_semi").select("adm_key", "adm_at", "adm_size"), "large-requests")
        fits.append(_phased(big, large, most, bucket))
    out = rows.join(reduce(DataFrame.unionByName, fits).withColumn("fits", F.lit(True)), ["adm_key", "adm_at"], "left")
    out = out.withColumn("fits", (F.col("adm_size") == 0) | F.coalesce("fits", F.lit(False)))
    held = {"reserved": ("sum", F.when(F.col("fits"), F.col("adm_size")).otherwise(0))}
    return carried(out, keys, F.date_trunc(bucket, ts), [ts, order], held).drop("adm_key", "adm_size", "adm_at")


def _folded(asks: DataFrame, most: int) -> DataFrame:
    """adm_key and adm_at of what fits; a key's rows are few and taken one after the other."""
    lists = asks.groupBy("adm_key").agg(F.array_sort(F.collect_list(F.struct("adm_at", "adm_size"))).alias("list"))
    at = asks.schema["adm_at"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast(f"array<{at}>").alias("fit"))

    def step(acc: Column, r: Column) -> Column:
        more = acc["held"] + r["adm_size"]
        return F.when(more <= most, F.struct(more.alias("held"), F.array_append(acc["fit"], r["adm_at"]).alias("fit"))).otherwise(acc)

    return lists.select("adm_key", F.explode(F.aggregate("list", start, step)["fit"]).alias("adm_at"))


def _phased(asks: DataFrame, keys: DataFrame, most: int, bucket: str) -> DataFrame:
    """adm_key and adm_at of what fits, phase by phase for all keys at once."""
    small, at = 2 * F.col("adm_size") <= F.col("left"), F.col("adm_at")
    after = lambda since: F.col(since).isNull() | (at > F.col(since))
    opened = stored(keys.select("adm_key", F.lit(None).cast(asks.schema["adm_at"].dataType).alias("since"), F.lit(most).cast("long").alias("left")), "open-keys")
    parts, (ts, order) = [], asks.schema["adm_at"].dataType.names
    while not opened.isEmpty():
        now = asks.join(broadcast_if_few(opened), "adm_key").where(after("since") & (F.col("adm_size") <= F.col("left")))
        now = now.withColumns({"adm_ts": F.col(f"adm_at.{ts}"), "adm_order": F.col(f"adm_at.{order}")})
        now = carried(now, ["adm_key"], F.date_trunc(bucket, "adm_ts"), ["adm_ts", "adm_order"], {"sum": ("sum", F.when(small, F.col("adm_size")).otherwise(0))})
        now = stored(now.withColumn("taken", F.when(small, F.col("sum")).otherwise(F.col("sum") + F.col("adm_size"))), "phase")
        ends = F.when(small, 2 * F.col("taken") > F.col("left")).otherwise(F.col("taken") <= F.col("left"))
        end = stored(now.where(ends).groupBy("adm_key", "left").agg(F.min(F.struct("adm_at", "taken")).alias("end")).select("adm_key", F.col("end.adm_at").alias("until"), (F.col("left") - F.col("end.taken")).alias("rest")), "phase-ends")
        done = now.join(broadcast_if_few(end), "adm_key", "left").where(F.col("until").isNull() | (at <= F.col("until")))
        parts.append(done.where(small | (at == F.col("until"))).select("adm_key", "adm_at"))
        opened = stored(end.where("rest > 0").select("adm_key", F.col("until").alias("since"), F.col("rest").alias("left")), "open-keys")
    return reduce(DataFrame.unionByName, parts)


def reservations(rows: DataFrame, keys: list[str], ts: str, order: str, amount: str, most: int, bucket: str = "second") -> DataFrame:
    """``rows`` with fits and reserved as ``admitted`` has them, but negative amounts give back what their key has reserved, down to nothing (O12.5).

    ``most`` is small: what a bucket's rows do is written down for each of the ``most + 1`` sums that may be reserved before them, so that
    buckets are worked on alone, and a key's are then gone through one by one. So ``keys`` should bound how many buckets a key has (a minute
    has 60), and no list is longer than a bucket's rows or a key's buckets. Null amounts reserve nothing; a row without a time is in a first bucket.
    """
    asks = rows.select(F.struct(*keys).alias("res_key"), F.date_trunc(bucket, ts).alias("res_bucket"), F.struct(F.col(ts), F.col(order)).alias("res_at"), F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("res_size"), F.struct(*[F.col(c) for c in rows.columns]).alias("res_row"))
    same = ["res_key", "res_bucket"]
    buckets = stored(asks.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("res_at", "res_size", "res_row"))).alias("list")), "buckets")
    fit = lambda held, r: (r["res_size"] <= 0) | (held + r["res_size"] <= most)
    after = lambda held, r: F.when(fit(held, r), F.greatest(held + r["res_size"], F.lit(0).cast("long"))).otherwise(held)
    whole = buckets.select(*same, F.transform(F.sequence(F.lit(0), F.lit(most)), lambda start: F.aggregate("list", start.cast("long"), after)).alias("leads_to"))
    of_key = whole.groupBy("res_key").agg(F.array_sort(F.collect_list(F.struct("res_bucket", "leads_to"))).alias("list"))  # a key's buckets
    none = F.array().cast("array<struct<res_bucket:%s,held:bigint>>" % whole.schema["res_bucket"].dataType.simpleString())
    walk = F.aggregate(
        "list", F.struct(F.lit(0).cast("long").alias("held"), none.alias("before")),
        lambda acc, b: F.struct(F.get(b["leads_to"], acc["held"].cast("int")).alias("held"), F.array_append(acc["before"], F.struct(b["res_bucket"].alias("res_bucket"), acc["held"].alias("held"))).alias("before")),
    )
    starts = of_key.select("res_key", F.explode(walk["before"]).alias("b")).select(F.col("res_key").alias("start_key"), F.col("b.res_bucket").alias("start_bucket"), F.col("b.held").alias("held")).hint("merge")
    met = buckets.join(starts, F.col("res_key").eqNullSafe(F.col("start_key")) & F.col("res_bucket").eqNullSafe(F.col("start_bucket")))
    held = F.aggregate("list", F.array("held"), lambda acc, r: F.array_append(acc, after(F.element_at(acc, -1), r)))
    each = met.select(held.alias("held_all"), F.posexplode("list").alias("i", "r"))
    before, reserved = F.get("held_all", F.col("i")), F.get("held_all", F.col("i") + 1)
    return each.select(*[F.col("r.res_row")[c].alias(c) for c in rows.columns], fit(before, F.col("r")).alias("fits"), reserved.alias("reserved"))


def admissions(rows: DataFrame, user: str, provider: str, remote: Column, ts: str, order: str, tokens: str, per_day: int, per_minute: int, budget: int) -> DataFrame:
    """``rows`` (requests) with user_count, minute_count, outcome and reserved (O12.5).

    Requests are counted for each user and day and each provider and minute, refused ones too. A request beyond ``per_day`` is
    refused (``user_limit``), then one beyond ``per_minute`` (``rate_limit``). Those of ``remote`` providers then reserve their
    tokens from one budget a day, and are refused (``budget``) without a trace if they don't fit. All others are ``admitted``.
    reserved is what the day's requests have reserved after this one.
    """
    rows = rows.withColumns({"lim_day": F.date_trunc("day", ts), "lim_minute": F.date_trunc("minute", ts)})
    rows = carried(rows, [user, "lim_day"], F.date_trunc("hour", ts), [ts, order], {"user_count": ("count", F.lit(1))})
    rows = carried(rows, [provider, "lim_minute"], F.date_trunc("second", ts), [ts, order], {"minute_count": ("count", F.lit(1))})
    stop = F.when(F.col("user_count") > per_day, "user_limit").when(F.col("minute_count") > per_minute, "rate_limit")
    rows = rows.withColumn("lim_stop", stop).withColumn("lim_asks", F.when(F.col("lim_stop").isNull() & remote, F.col(tokens)))
    rows = admitted(rows, ["lim_day"], ts, order, "lim_asks", budget)
    outcome = F.coalesce("lim_stop", F.when(F.col("fits"), "admitted").otherwise("budget"))
    return rows.withColumn("outcome", outcome).drop("fits", "lim_day", "lim_minute", "lim_stop", "lim_asks")


def lockouts(rows: DataFrame, key: str, ts: str, order: str, failed: Column, most: int, seconds: int, guarded: bool = True) -> DataFrame:
    """``rows`` (attempts) with failures (those counted after the row), outcome and locked_until (O12.6).

    A counter starts at a key's first failure and expires ``seconds`` later, whatever comes in between; a success clears it and
    the lock. A failure that brings it to ``most``, or finds it there, locks the key for ``seconds`` from then on. Outcomes are
    ``failed``, ``locked`` (a failure that locks) and ``passed``. ``guarded``: attempts at a locked key are ``refused`` and
    neither count nor clear; else they do, and each failure renews the lock. A null ``failed`` is a success; (ts, order) tells the
    attempts of a key apart.

    Each failure is linked with the first one that would start the next counter if it started one itself; from a key's first
    failure on, pointer doubling then marks the real starts, in as many rounds as the longest chain has bits. Joins are by key and
    number of the failure, prefixes are carried over from day to day, so a key with a third of all rows is worked on in parts.
    """
    length = F.expr(f"INTERVAL {seconds} SECONDS")
    is_failure = F.coalesce(failed, F.lit(False))
    day = F.date_trunc("day", ts)
    rows = rows.withColumns({"lock_key": F.struct(key), "lock_failed": is_failure, "lock_at": F.struct(F.col(ts).alias("ts"), F.col(order).alias("order"))})
    rows = carried(rows, ["lock_key"], day, [ts, order], {"lock_number": ("count", F.when(F.col("lock_failed"), 1))})
    rows = carried(rows, ["lock_key"], day, [ts, order], {"lock_success": ("first", F.when(~F.col("lock_failed"), F.col("lock_at")))}, ahead=True)
    rows = stored(rows, "attempts")
    fails = rows.where("lock_failed").select("lock_key", "lock_number", F.col("lock_at").alias("at"), F.col("lock_success").alias("success"))
    # The failure that would bring a counter started here to the limit.
    limit = fails.select("lock_key", (F.col("lock_number") - (most - 1)).alias("lock_number"), F.col("at").alias("full"))
    fails = fails.join(limit, ["lock_key", "lock_number"], "left")
    expires = F.col("at.ts") + length
    cleared = F.col("success").isNotNull() & (F.col("success.ts") < expires)
    locks = F.col("full").isNotNull() & (F.col("full.ts") < expires) & (F.col("success").isNull() | (F.col("full") < F.col("success"))) if guarded else F.lit(False)
    at_time = lambda t: F.struct(t.alias("ts"), F.lit(None).cast(rows.schema[order].dataType).alias("order"))  # noqa: E731  before all of that time
    fails = fails.withColumns({"locks": locks, "resume": F.when(locks, at_time(F.col("full.ts") + length)).when(cleared, F.col("success")).otherwise(at_time(expires))})
    fails = stored(fails, "failures")
    starts = _chain(fails)
    rows = asof_join(rows, starts.select("lock_key", F.col("at.ts").alias("start_ts"), F.col("at.order").alias("start_order"), F.col("lock_number").alias("start_number"), "resume", "locks", "full"), ["lock_key"], ts, "start_ts", ["start_order", "start_number", "resume", "locks", "full"], left_order=order, right_order="start_order")
    inside = F.col("resume").isNotNull() & (F.col("lock_at") < F.col("resume"))
    count = F.when(inside & F.col("lock_failed"), F.col("lock_number") - F.col("start_number") + 1)
    if guarded:
        closed = inside & F.col("locks") & (F.col("lock_at") >= F.col("full"))
        # Refused attempts leave the counter where it was.
        counted = F.when(closed, F.lit(most)).when(inside & ~F.col("lock_failed"), F.lit(0)).otherwise(F.coalesce(count, F.lit(0)))
        outcome = F.when(closed & (F.col("lock_at") > F.col("full")), "refused").when(closed, "locked").when(F.col("lock_failed"), "failed").otherwise("passed")
        rows = rows.withColumns({"failures": counted.cast("long"), "outcome": outcome, "locked_until": F.when(closed, F.col("full.ts") + length)})
    else:
        rows = rows.withColumn("failures", F.coalesce(count, F.lit(0)).cast("long"))
        rows = rows.withColumn("outcome", F.when(~F.col("lock_failed"), "passed").when(F.col("failures") >= most, "locked").otherwise("failed"))
        until = F.when(F.col("outcome") == "locked", F.struct((F.col(ts) + length).alias("until"))).when(F.col("outcome") == "passed", F.struct(F.lit(None).cast(rows.schema[ts].dataType).alias("until")))
        rows = carried(rows, ["lock_key"], day, [ts, order], {"lock_until": ("last", until)})
        rows = rows.withColumn("locked_until", F.when(F.col("lock_until.until") > F.col(ts), F.col("lock_until.until")))
    return rows.drop("lock_key", "lock_failed", "lock_at", "lock_number", "lock_success", "lock_until", "start_order", "start_number", "resume", "locks", "full")


def _chain(fails: DataFrame) -> DataFrame:
    """The rows of ``fails`` (lock_key, lock_number, at, resume) that a key's first one leads to by way of each one's first failure from
    ``resume`` on."""
    probes = fails.select("lock_key", "lock_number", F.col("resume.ts").alias("probe_ts"), F.col("resume.order").alias("probe_order"))
    found = fails.select("lock_key", F.col("lock_number").alias("next"), F.col("at.ts").alias("fail_ts"), F.col("at.order").alias("fail_order"))
    links = asof_join(probes, found, ["lock_key"], "probe_ts", "fail_ts", ["next"], left_order="probe_order", right_order="fail_order", forward=True)
    jump = stored(links.where("next is not null").select("lock_key", "lock_number", "next"), "links")
    reached = stored(fails.groupBy("lock_key").agg(F.min("lock_number").alias("lock_number")), "first-failures")
    parts = [reached]
    while True:
        new = stored(reached.join(jump, ["lock_key", "lock_number"]).select("lock_key", F.col("next").alias("lock_number")), "reached")
        if new.isEmpty():
            return fails.join(reduce(DataFrame.unionByName, parts), ["lock_key", "lock_number"], "left_semi")
        parts.append(new)
        reached = reduce(DataFrame.unionByName, parts)
        onward = jump.select("lock_key", F.col("lock_number").alias("next"), F.col("next").alias("after"))
        jump = stored(jump.join(onward, ["lock_key", "next"]).select("lock_key", "lock_number", F.col("after").alias("next")), "links")
