"""The register of queries and their SQL, and the driver tables' readings as domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled_fields
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The moment at which queries look at the events.
NOW = "2024-01-30 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as occurrences of records (customers) at sources (priorities)."""
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_totalprice") < 60000, " ").otherwise(F.col("o_orderpriority"))
    description = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    url = F.when(F.col("o_totalprice") < 200000, "").otherwise(F.concat(F.lit("https://a.example/"), F.col("o_orderkey").cast("string")))
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "removed").otherwise("invalid")
    return o.select(
        F.col("o_orderkey").alias("occurrence_id"),
        F.col("o_custkey").alias("record_id"),
        F.col("o_orderpriority").alias("source"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        status.alias("status"),
        F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("confidence"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 7).cast("int").alias("page"),
        filled_fields(title, description, url).alias("filled"),
        F.col("o_orderdate").alias("scraped_at"),
    )


#: The same in SQL, for use as a WITH item.
OCC = """occ AS (SELECT o_orderkey AS occurrence_id, o_custkey AS record_id, o_orderpriority AS source, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'removed' ELSE 'invalid' END AS status, least(o_totalprice / 500000, 1.0) AS confidence,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 7 AS INTEGER) END AS page, CAST(o_totalprice >= 60000 AS INTEGER) + CAST(o_orderstatus <> 'O' AS INTEGER) + CAST(o_totalprice >= 200000 AS INTEGER) AS filled, o_orderdate AS scraped_at FROM orders)"""
CANON = """canon AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(page, 2147483647), priority, filled DESC, scraped_at DESC, occurrence_id DESC) AS rn
  FROM occ WHERE status = 'active') WHERE rn = 1)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of ten sources."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    return e.select(
        F.col("event_id").alias("run_id"), (F.col("user_id") % 10).alias("source_id"), status.alias("status"),
        F.col("ts").alias("started_at"), F.floor(F.col("value")).cast("long").alias("items"), "user_id", "event_type",
    )


RUN = """run AS (SELECT event_id AS run_id, user_id % 10 AS source_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status,
  ts AS started_at, CAST(floor(value) AS BIGINT) AS items, user_id, event_type FROM events)"""


def url_key(url: str) -> str:
    """SQL that gives the comparable form of an address."""
    names = "['scheme', 'host', 'path', 'query']"
    u = f"regexp_extract(trim({url}), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', {names})"
    path = f"regexp_replace({u}.path, ';[^/]*$', '')"
    pairs = f"list_transform(list_filter(string_split({u}.query, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(x, length(split_part(x, '=', 1)) + 2), '+', ' '))}})"
    own = f"list_filter({pairs}, lambda x: lower(x.k) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'msclkid', 'ref', 'referrer'))"
    query = f"array_to_string(list_transform(list_sort({own}), lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&')"
    return (
        f"CASE WHEN {u}.scheme <> '' THEN lower({u}.scheme) || ':' ELSE '' END || CASE WHEN {u}.host <> '' THEN '//' || lower({u}.host) ELSE '' END"
        f" || CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/+$', '') ELSE {path} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
    )
