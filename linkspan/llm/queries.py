"""The operators as queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import ORACLE as LEAKS_SQL
from .decontaminate import decontaminate
from .fill_middle import ORACLE as MIDDLE_SQL
from .fill_middle import fill_in_middle, restored
from .html_text import extract_text
from .id_store import store_round_trip
from .licenses import scan_licenses
from .line_dedup import ORACLE as LINES_SQL
from .line_dedup import dedup_lines
from .packing import pack_documents
from .quality_gbt import apply_rules, fit_rules
from .quality_knn import fit_knn, score_documents
from .secrets import corpus_samples, fit_ratio, name_samples, random_samples, scan_secrets
from .simhash import near_duplicates
from .token_counts import count_tokens
from .vector_codes import ORACLE as CODES_SQL
from .vector_codes import compress_vectors, errors_by_label


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = random_samples(spark).unionByName(name_samples(spark)).unionByName(corpus_samples(docs), allowMissingColumns=True)
    return scan_secrets(docs, fit_ratio(samples))


def op4_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def _fold() -> Column:
    """crc32 of doc_id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_knn(docs, table(spark, sf_dir, "labels"), where=_fold() != 0)
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store_round_trip(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return errors_by_label(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_harmonic_packing, op2_simhash_pivots, op3_markov_secrets, op4_block_rules, op5_token_counts,
        op6_line_chunks, op7_quality_votes, op8_id_store, op9_prefix_join, op10_quality_rules,
        op11_license_rules, op12_fill_middle, op13_delta_lloyd,
    )
}
#: The other operators' results depend on models, tokenizers or bit-wise hashes; tests hold them against brute force.
ORACLES: dict[str, str] = {"op6_line_chunks": LINES_SQL, "op9_prefix_join": LEAKS_SQL, "op12_fill_middle": MIDDLE_SQL, "op13_delta_lloyd": CODES_SQL}
