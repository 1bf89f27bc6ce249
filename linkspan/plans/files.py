"""Feeds, exports and publication: written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import export_csv, export_json, parse_feed, read_csv, read_json, scratch, table
from ..streaming import jobs
from .registry import query


@query("""WITH l AS (SELECT event_id, 'h' || user_id || '.example' AS host, CASE WHEN event_id % 5 = 3 THEN 'x' WHEN event_id % 5 = 4 THEN '70000' ELSE CAST(8000 + event_id % 3 AS VARCHAR) END AS port, event_type AS u, props AS p FROM events)
SELECT host, CAST(port AS INTEGER) AS port, arg_max(u, event_id) AS "user", 's' || max(event_id) AS secret FROM l WHERE event_id % 5 < 3 AND event_id % 7 <> 0 GROUP BY 1, 2""")
def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a proxy feed, the last of a host and port; comments, broken ports and short lines go (O1.8)."""
    i = F.col("event_id")
    port = F.when(i % 5 == 3, "x").when(i % 5 == 4, "70000").otherwise((8000 + i % 3).cast("string"))
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example"))
    line = F.concat(F.when(i % 7 == 0, F.lit("# ")).otherwise(F.lit("  ")), F.concat_ws(":", host, port, "event_type", F.concat(F.lit("s"), i.cast("string"))))
    return parse_feed(table(spark, sf_dir, "events").select(i.alias("line_no"), line.alias("value")))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back (O1.13)."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "json")
    export_json(docs, path)
    return read_json(spark, path, docs.schema)


@query("""SELECT doc_id, text, lang, '{"n":' || n_chars || ',"source":"' || source || '"}' AS extra FROM documents""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV, line ends and quotes in their texts and a nested column as JSON, and read back (O1.12)."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "csv")
    export_csv(docs.select("doc_id", "text", "lang", F.struct("source", F.col("n_chars").alias("n")).alias("extra")), path)
    return read_csv(spark, path, "doc_id long, text string, lang string, extra string")


@query("SELECT event_id, user_id, event_type FROM events")
def published_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, each micro-batch published once under its number, and all of it read back (O12.1)."""
    out, schema = scratch(spark, "published"), table(spark, sf_dir, "events").schema
    jobs.publish(jobs.read_events(spark, f"{sf_dir}/events*.parquet", schema), out, scratch(spark, "published-checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


_STAGED = """s AS (SELECT user_id, ts, least(5, CAST(floor(event_id * 6 / (SELECT max(event_id) + 1 FROM events)) AS INTEGER) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END) AS stage FROM events),
m AS (SELECT s.*, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM s b WHERE b.stage < s.stage - 1) AS mark FROM s), late AS (SELECT count(*) AS n FROM m WHERE ts <= mark),
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM m WHERE mark IS NULL OR ts > mark WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
o AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM n GROUP BY user_id, k)"""


@query(f"""WITH {_STAGED} SELECT o.*, (SELECT n FROM late) AS late_rows FROM o WHERE "end" + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over all events, in six batches of which some rows come two batches late, run to its end: sessions that timers closed after twelve
    silent hours, and how many rows came too late (O12.4)."""
    e, inbox = table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), scratch(spark, "inbox")
    count = e.agg(F.max("event_id")).scalar() + 1
    stage = F.least(F.lit(5), F.floor(F.col("event_id") * 6 / count) + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0))
    for i in range(6):
        e.where(stage == i).repartition(4).write.mode("append").parquet(inbox)
    stream = jobs.timed_sessions(jobs.read_events(spark, inbox, e.schema, files=4), 12 * 3600, "1 hour")
    out, late = jobs.run_to_end(stream, scratch(spark, "sessions"), scratch(spark, "sessions-checkpoint"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.lit(late).cast("long").alias("late_rows"))
