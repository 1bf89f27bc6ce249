"""The corpus pipeline: quality, repeated passages, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet before the next one reads it.
All but the last return the columns of the documents they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm.common import materialize, named_back, set_aside, table
from linkspan.llm.decontaminate import decontaminate
from linkspan.llm.line_dedup import dedup_lines
from linkspan.llm.packing import pack_documents
from linkspan.llm.quality_knn import fit_knn, score_documents
from linkspan.llm.similar import similar_documents


def _on(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after an operator on them: all but doc_id and text wait under names of their own, so
    that no column of the documents (uid, score, n_words, keep, ...) can clash with one that the operator adds."""
    kept, names = set_aside(docs, "doc_id", "text")
    return operator(kept).select(*named_back(names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes call bad go.

    A null, an empty or a very long text is judged like any other; repeated rows fare alike; rows with a null
    doc_id are judged, too; no documents or no labels give none or a score of 0.5.
    """
    model = fit_knn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _on(docs, lambda kept: score_documents(kept, model).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out, all of those of 50 words or more; every document stays.

    A null text stays null; of repeated rows the first keeps its passages; null ids come last. ``n_chars``, where
    there is one, is counted anew.
    """
    out = _on(docs, dedup_lines)
    counted = [c for c in docs.columns if c.lower() == "n_chars"]
    return out.withColumns({c: F.length("text").cast(docs.schema[c].dataType) for c in counted})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Near-duplicates share 80 % of their shingles of five words; sketches make the candidates, sizes and SimHash
    distances discard pairs. The pivot table is kept, but discards next to nothing at this similarity. Null and
    empty texts are one group; of rows with equal ids the first stays; a null id is larger than all others.
    """
    return _on(docs, lambda kept: similar_documents(kept).where("keep"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts are clean; each row is judged by itself."""
    return _on(docs, lambda kept: decontaminate(kept, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences of 2048 token ids. Null texts are empty, null ids and repeated rows stay."""
    pieces = pack_documents(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", leaks), ("packing", packing)]

#: Vectors, fingerprints and token ids are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
