from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkspan.operators import health, limits
from linkspan.streaming import jobs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"
T0 = datetime(2024, 1, 1)


def stream(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(path)
    return jobs.read_events(spark, path, spark.createDataFrame([], EVENTS).schema)


def run(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_windows_over_driver_events(spark):
    path = "/root/testdata/sf0.001/events*.parquet"
    schema = spark.read.parquet(path).schema
    got = run(jobs.windowed_counts(jobs.read_events(spark, path, schema), "1 hour", "7 days", "event_type"), "hours", "complete")
    want = spark.read.parquet(path).groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.select("start", "event_type", "n").collect()} == {tuple(r) for r in want.collect()}


def test_cooldown_twin(spark, tmp_path):
    kinds = ["error", "error", "view", "error", "error", "error", "error", "error"]
    rows = [(i, T0 + timedelta(minutes=i), i % 2, kinds[i]) for i in range(len(kinds))]
    events = stream(spark, str(tmp_path / "in"), rows)
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    got = {(r.event_id, r.failures, r.cooldown_until) for r in run(jobs.cooldowns(events), "cool").collect()}
    batch = health.cooldowns(spark.createDataFrame(rows, EVENTS), "user_id", "ts", F.col("event_type") == "error", "event_id")
    assert got == {(r.event_id, r.failures, r.cooldown_until) for r in batch.collect()}


def test_dedup_sessions_and_publication(spark, tmp_path):
    rows = [(1, T0, 1, "a"), (1, T0, 1, "a"), (2, T0 + timedelta(minutes=5), 1, "a"), (3, T0 + timedelta(hours=3), 1, "a")]
    events = stream(spark, str(tmp_path / "in"), rows)
    assert sorted(r.event_id for r in run(jobs.dedup(events, ["event_id"], "1 day"), "dedup").collect()) == [1, 2, 3]
    assert {r.n for r in run(jobs.sessions(events, "30 minutes", "1 day", "user_id"), "sessions", "complete").collect()} == {3, 1}
    jobs.publish(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_silent_keys_are_forgotten_and_late_rows_dropped(spark, tmp_path):
    """A streak goes on over micro-batches, ends with its state after a silent day, and rows behind the watermark go."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], EVENTS).write.parquet(path)
    schema = spark.createDataFrame([], EVENTS).schema
    query = lambda: jobs.cooldowns(jobs.read_events(spark, path, schema), "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    days = lambda *x: timedelta(days=x[0], minutes=x[1] if len(x) > 1 else 0)
    for rows in (
        [(1, T0, 1, "error"), (2, T0 + days(0, 1), 1, "error")], [(3, T0 + days(0, 2), 1, "error")], [(4, T0 + days(5), 2, "view")], [(5, T0 + days(6), 2, "view")],
        [(6, T0, 3, "error"), (7, T0 + days(6, 1), 1, "error")],
    ):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
        query().awaitTermination()
    got = {r.event_id: r.failures for r in spark.read.parquet(out).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 0, 5: 0, 7: 1}


def test_reservations_as_they_come(spark, tmp_path):
    """As the batch form has them, over several micro-batches; what is given back can be reserved again."""
    schema = "ts timestamp_ntz, id long, key string, amount long"
    path = str(tmp_path / "in")
    parts = [[(T0, 1, "d1", 90), (T0 + timedelta(minutes=1), 2, "d1", 50)], [(T0 + timedelta(minutes=2), 3, "d1", 10), (T0 + timedelta(minutes=3), 4, "d1", 1), (T0, 5, "d2", 100)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    events = lambda: jobs.read_events(spark, path, spark.createDataFrame([], schema).schema, files=1)
    out, _ = jobs.run_to_end(jobs.admitted(events(), 100), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = limits.admitted(spark.createDataFrame([r for p in parts for r in p], schema), ["key"], "ts", "id", "amount", 100)
    assert {(r.id, r.fits, r.reserved) for r in out.collect()} == {(r.id, r.fits, r.reserved) for r in batch.collect()} == {(1, True, 90), (2, False, 90), (3, True, 100), (4, False, 100), (5, True, 100)}
    spark.createDataFrame([(T0 + timedelta(minutes=9), 6, "d1", -90), (T0 + timedelta(minutes=9), 7, "d1", 80)], schema).coalesce(1).write.mode("append").parquet(path)
    again, _ = jobs.run_to_end(jobs.admitted(events(), 100), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.id, r.fits, r.reserved) for r in again.where("id > 5").collect()} == {(6, True, 10), (7, True, 90)}


def test_sessions_that_timers_close(spark, tmp_path):
    """Rows in any order within the delay join sessions that were apart; open sessions stay in state; late rows are counted."""
    schema = "event_id long, user_id long, ts timestamp_ntz"
    path = str(tmp_path / "in")
    at = lambda h: T0 + timedelta(hours=h)
    for rows in ([(1, 1, at(0)), (2, 1, at(3)), (3, 2, at(1))], [(4, 1, at(1.5)), (5, 2, at(20))], [(6, 3, at(21))], [(7, 9, at(0)), (8, 1, at(22))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    events = jobs.read_events(spark, path, spark.createDataFrame([], schema).schema, files=1)
    out, late = jobs.run_to_end(jobs.timed_sessions(events, 2 * 3600, "4 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.user_id, r.start.replace(tzinfo=None), r.end.replace(tzinfo=None), r.n) for r in out.collect()}
    assert got == {(1, at(0), at(3), 3), (2, at(1), at(1), 1)} and late == 1


def test_sessions_of_many_users_share_state_and_timers(spark, tmp_path):
    """Against a plain reading: what is called for each micro-batch doesn't grow with users; rows without a user or a time."""
    schema = "event_id long, user_id long, ts timestamp_ntz"
    path, none = str(tmp_path / "in"), (99_999, None)
    at = lambda h: T0 + timedelta(hours=h)
    users = [*range(600), None]
    parts = [[(i, u, at(h + i % 7 / 8)) for i, u in enumerate(users) for h in (0, 1.5, 6)] + [(*none, None), (1, 5, None)], [(i, u, at(h)) for i, u in enumerate(users) for h in (8.5, 11)] + [(1, -1, at(40))], [(1, -1, at(40))]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    events = jobs.read_events(spark, path, spark.createDataFrame([], schema).schema, files=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs._ROCKS)
    try:
        q = jobs.timed_sessions(events, 2 * 3600, "4 hours").writeStream.format("memory").queryName("shared_sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = set()
    for u in users:
        times = sorted(t for part in parts for _, v, t in part if v == u and t)
        for t in times:
            if t == times[0] or t - last > timedelta(hours=2):
                start, n = t, 0
            n, last = n + 1, t
            want = {w for w in want if w[:2] != (u, start)} | {(u, start, last, n)}
    got = spark.table("shared_sessions").collect()
    assert len(got) == len(want) and {(r.user_id, r.start.replace(tzinfo=None), r.end.replace(tzinfo=None), r.n) for r in got} == want
    timers = [op["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for op in p["stateOperators"]]
    assert 0 < max(timers) <= 257
