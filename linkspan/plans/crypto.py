"""Keyed hashes and authenticated encryption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hmac_sha256
from ..sources.tables import table
from .registry import query

_KEY = b"0123456789abcdef0123456789abcdef"


_PADS = [bytes(b ^ byte for b in _KEY.ljust(64, b"\0")).hex() for byte in (0x36, 0x5C)]


@query(f"""SELECT c_nationkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(CAST(c_nationkey AS VARCHAR))))) AS keyed_hash, count(*) AS n FROM customer GROUP BY 1, 2""")
def keyed_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal keyed hashes, which are the groups of equal values (O9.3)."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", hmac_sha256(F.col("c_nationkey").cast("string"), _KEY).alias("keyed_hash"))
    return c.groupBy("keyed_hash").agg(F.first("c_nationkey").alias("c_nationkey"), F.count("*").alias("n")).select("c_nationkey", "keyed_hash", "n")


@query("SELECT c_custkey, c_name, true AS changed, true AS wrong_key_fails, 12 + octet_length(encode(c_name)) + 16 AS sealed_bytes FROM customer")
def aes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AES-GCM there and back (O9.6): 12 bytes of nonce, the text's own and a tag of 16; another key opens nothing."""
    sealed = F.aes_encrypt(F.col("c_name"), F.lit(_KEY), F.lit("GCM"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", sealed.alias("sealed"))
    opened = F.try_aes_decrypt(F.col("sealed"), F.lit(_KEY), F.lit("GCM")).cast("string")
    other = F.try_aes_decrypt(F.col("sealed"), F.lit(_KEY[::-1]), F.lit("GCM"))
    return c.select("c_custkey", opened.alias("c_name"), (F.col("sealed") != F.col("c_name").cast("binary")).alias("changed"), other.isNull().alias("wrong_key_fails"), F.octet_length("sealed").alias("sealed_bytes"))
