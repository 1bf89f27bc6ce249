"""Set operations and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import keyset_page, table
from .registry import query


@query("""SELECT 'missing' AS kind, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT 'extra', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys missing on one side and extra on the other (O7.2)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    missing = c.join(o, "key", "left_anti").select(F.lit("missing").alias("kind"), "key")
    extra = o.join(c.where("key % 2 = 0"), "key", "left_anti").distinct().select(F.lit("extra").alias("kind"), "key")
    return missing.unionByName(extra)


@query("SELECT DISTINCT k FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem UNION ALL SELECT p_partkey FROM part)")
def reference_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys that any of several columns holds (O7.3)."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").unpivot([], ["l_partkey", "l_suppkey"], "column", "k").select("k")
    return l.unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))).distinct()


@query("""SELECT s_suppkey AS source, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49) AS in_use FROM supplier""")
def delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May a source be deleted, or does a row refer to it (O2.13)?"""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("source")).distinct().withColumn("u", F.lit(True))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source")).join(used, "source", "left").select("source", F.col("u").isNotNull().alias("in_use"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
def keyset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk of a keyset scan (O1.15)."""
    return keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)
