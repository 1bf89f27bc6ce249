"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, n_tokens), in folders by tokenizer digest.
Documents meet it by the digest of their content (the UTF-8 bytes, null as empty: nothing that could change a
count is folded); of the cache, only the rows of the digests at hand take part. Only contents missing from it are
encoded, each once however many documents have it, and appended. A later call with the same cache encodes
nothing that was seen before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, settle, shared_folder
from .tokens import encoder, public_path

CACHE = "content_digest binary, n_tokens long, tokenizer_digest string"
COUNTS = "content_digest binary, n_tokens long"
#: Digests (some 60 bytes each) that may be broadcast to read a cache; more are shuffled with it.
BROADCAST_ROWS = 200_000


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [enc.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache_path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for each row of ``docs``.

    ``cache_path`` names the cache table, which is made if it is missing; None takes a new one. A null
    text counts as empty (0 tokens); null ids and repeated rows each keep their row; an empty table
    gives no rows; very long texts are counted whole. Other columns are ignored. Copies are combined before the
    shuffle, so that a text which a third of the rows share travels once from each task.
    """
    spark = docs.sparkSession
    path = tokenizer or public_path("byte_bpe_50k.json")
    version, cache_path = tokenizer_digest(path), cache_path or shared_folder(spark, "token-cache")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest")
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "content-digests")

    def counts() -> DataFrame:
        spark.createDataFrame([], CACHE).write.partitionBy("tokenizer_digest").mode("append").parquet(cache_path)
        at_hand = materialize(rows.select("content_digest").distinct(), "distinct-digests")
        cache = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")
        known = cache.join(broadcast_if_small(at_hand, at_hand.count(), BROADCAST_ROWS), "content_digest", "left_semi")
        known = materialize(known.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens")), "known-counts")
        one_each = docs.select(digest, text.alias("text")).groupBy("content_digest").agg(F.first("text").alias("text"))
        misses = one_each.join(known, "content_digest", "left_anti")
        new = materialize(misses.mapInArrow(_count(path), COUNTS), "new-counts")
        new.withColumn("tokenizer_digest", F.lit(version)).write.partitionBy("tokenizer_digest").mode("append").parquet(cache_path)
        return known.unionByName(new)

    counted = settle(spark, "token-counts", counts)  # a table, so that a hot digest's rows can be split
    return rows.join(counted, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
