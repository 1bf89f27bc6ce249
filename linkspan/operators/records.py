"""Records, their occurrences and the occurrence that stands for a record."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import VERIFIED, half_up
from ..sources.tables import stored

LAST_PAGE = 2147483647


def canonical_rank() -> Column:
    """Known low pages first, then priority, completeness, recency and id: the greatest struct wins (O4.12)."""
    return F.struct(-F.coalesce("page", F.lit(LAST_PAGE)), -F.col("priority"), F.col("filled"), F.col("scraped_at"), F.col("occurrence_id"))


def canonical(occurrences: DataFrame) -> DataFrame:
    """The active occurrence that stands for each record; records without one have no row (O4.12).

    ``max_by`` over a struct combines in each task, so a record of any size shuffles one row a task.
    """
    rest = [c for c in occurrences.columns if c != "record_id"]
    best = occurrences.where("status = 'active'").groupBy("record_id").agg(F.max_by(F.struct(*rest), canonical_rank()).alias("c"))
    return best.select("record_id", "c.*")


def overview(occurrences: DataFrame, *more: Column) -> DataFrame:
    """Occurrences, distinct sources, first and last time of each record, and ``more`` aggregates (O4.2)."""
    return occurrences.groupBy("record_id").agg(
        F.count("*").alias("occurrences"), F.count_distinct("source").alias("sources"),
        F.min("scraped_at").alias("first_seen"), F.max("scraped_at").alias("last_seen"), *more,
    )


def status_filter(status: str, confidence: Column) -> Column:
    """verified, unverified (null too) or flagged, which nothing is (O2.5)."""
    if status == "verified":
        return confidence >= VERIFIED
    if status == "unverified":
        return (confidence < VERIFIED) | confidence.isNull()
    return F.lit(False)


def search(records: DataFrame, occurrences: DataFrame, status: str | None = None, source: str | None = None, seen_from: datetime | None = None, seen_to: datetime | None = None, ids: list | None = None) -> DataFrame:
    """Records (record_id, ...) with overview and canonical occurrence under the filters given (O2.4, O3.2, O3.3, O3.5, O3.6).

    Records without occurrences don't appear. A source filter is a semi-join; the overview still counts all sources.
    """
    active = F.col("status") == "active"
    best = F.max_by(F.struct("occurrence_id", "source", "confidence"), F.when(active, canonical_rank())).alias("best")
    summary = overview(occurrences, best)  # occurrences are read and shuffled once for both
    out = records.join(summary, "record_id").select(
        *records.columns, *[c for c in summary.columns if c not in ("record_id", "best")],
        F.col("best.occurrence_id").alias("canonical_id"), F.col("best.source").alias("canonical_source"), F.col("best.confidence").alias("confidence"),
    )
    if source is not None:
        out = out.join(occurrences.where(F.col("source") == source).select("record_id"), "record_id", "left_semi")
    tests = []
    if status is not None:
        tests.append(status_filter(status, F.col("confidence")))
    if seen_from is not None:
        tests.append(F.col("last_seen") >= F.lit(seen_from).cast("timestamp_ntz"))
    if seen_to is not None:
        tests.append(F.col("first_seen") <= F.lit(seen_to).cast("timestamp_ntz"))
    if ids is not None:
        tests.append(F.col("record_id").isin(ids))
    return out.where(reduce(Column.__and__, tests)) if tests else out


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) in a total order (O6.2)."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def priority_impact(occurrences: DataFrame, source: str, priority: int) -> DataFrame:
    """Records of ``source``, and how many of their canonical occurrences change with its new priority (O8.12).

    Only records of that source are ranked again.
    """
    affected = occurrences.join(occurrences.where(F.col("source") == source).select("record_id").distinct(), "record_id", "left_semi")
    raised = affected.withColumn("priority", F.when(F.col("source") == source, F.lit(priority)).otherwise(F.col("priority")))
    old = canonical(affected).select("record_id", F.col("occurrence_id").alias("was"))
    new = canonical(raised).select("record_id", F.col("occurrence_id").alias("becomes"))
    records = affected.select("record_id").distinct()
    joined = records.join(old, "record_id", "left").join(new, "record_id", "left")
    return joined.agg(F.count("*").alias("records"), F.count_if(~F.col("was").eqNullSafe(F.col("becomes"))).alias("changed"))


def canonical_history(occurrences: DataFrame) -> DataFrame:
    """A row each time the running winner of a record changes as occurrences arrive, with what it won by (O5.8)."""
    arrival = Window.partitionBy("record_id").orderBy("scraped_at", "occurrence_id")
    so_far = arrival.rowsBetween(Window.unboundedPreceding, 0)
    active = F.when(F.col("status") == "active", F.struct(canonical_rank().alias("rank"), F.struct("occurrence_id", "page", "priority", "filled", "scraped_at").alias("o")))
    rows = occurrences.withColumn("winner", F.max(active).over(so_far)["o"])
    rows = rows.withColumn("previous", F.lag("winner.occurrence_id").over(arrival))
    part = lambda name: F.concat(F.lit(f"{name}="), F.coalesce(F.col(f"winner.{name}").cast("string"), F.lit("none")))
    reason = F.concat_ws(", ", part("page"), part("priority"), part("filled"), part("scraped_at"))
    changes = rows.where(F.col("winner").isNotNull() & ~F.col("winner.occurrence_id").eqNullSafe(F.col("previous")))
    return changes.select("record_id", "scraped_at", F.col("winner.occurrence_id").alias("occurrence_id"), "previous", reason.alias("reason"))


def erasure(keys: DataFrame, hashed: Column, suppressed: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The suppression list with the hashes of ``keys`` on it, and only then each table without their rows (O8.11).

    ``suppressed`` has key_hash, blocked and reason; a hash that is there keeps its row. What comes in later is held against the new
    list, so an erased record can't come back between the two.
    """
    name = keys.columns[0]
    new = keys.select(hashed.alias("key_hash")).distinct().join(suppressed.select("key_hash"), "key_hash", "left_anti")
    listed = suppressed.select("key_hash", "blocked", "reason").unionByName(new.select("key_hash", F.lit(0).cast("long").alias("blocked"), F.lit("erasure").alias("reason")))
    return stored(listed, "suppressed"), erase(keys.select(name), tables)


def erase(keys: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without rows whose key column is among ``keys`` (one column) (O8.11)."""
    name = keys.columns[0]
    return {t: rows.join(keys.select(F.col(name).alias(c)), c, "left_anti") for t, (rows, c) in tables.items()}


def impact(keys: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """For each key: rows of each table that hang on it, 0 if none (O4.19)."""
    name = keys.columns[0]
    out = keys.distinct()
    for t, (rows, c) in tables.items():
        counted = rows.groupBy(F.col(c).alias(name)).agg(F.count("*").alias(t))
        out = out.join(counted, name, "left")
    return out.select(name, *[F.coalesce(t, F.lit(0)).alias(t) for t in tables])


def retain(occurrences: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """Occurrences seen since the cutoff, and the canonical ones of the records that lost any (O8.9, O8.10)."""
    old = F.col("scraped_at") < F.lit(cutoff).cast("timestamp_ntz")
    kept = occurrences.where(~old)
    touched = kept.join(occurrences.where(old).select("record_id").distinct(), "record_id", "left_semi")
    return kept, canonical(touched)


#: Families of a detector's labels, and the scores that decide.
FAMILIES = {
    "explicit": ("BUTTOCKS_EXPOSED", "FEMALE_BREAST_EXPOSED", "FEMALE_GENITALIA_EXPOSED", "MALE_GENITALIA_EXPOSED", "ANUS_EXPOSED"),
    "face": ("FACE_FEMALE", "FACE_MALE"),
}
SAFE, EXPLICIT, FACE = 0.20, 0.65, 0.50


def detection_scores(detections: DataFrame, key: str, label: str, score: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> DataFrame:
    """For each key and family of labels, the largest score of its detections (O4.18); 0 without any, or where scores are null."""
    largest = lambda labels: F.coalesce(F.max(F.when(F.col(label).isin(*labels), F.col(score))), F.lit(0.0))
    return detections.groupBy(key).agg(*[largest(labels).alias(name) for name, labels in families.items()])


def media_class(explicit: Column, face: Column, safe: float = SAFE, limit: float = EXPLICIT) -> list[Column]:
    """class, confidence and review of a medium by its scores (O11.11)."""
    is_explicit, is_safe = explicit >= limit, explicit < safe
    name = F.when(is_explicit, "explicit").when(is_safe, "safe").otherwise("unclassified")
    review = F.when(is_explicit, face >= FACE).otherwise(~is_safe)
    return [name.alias("class"), half_up(F.when(~is_explicit & is_safe, 1.0 - explicit).otherwise(explicit), 6).alias("confidence"), review.alias("review")]
