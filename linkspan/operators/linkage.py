"""Keys, duplicates, upserts, versions and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .carry import carried


def dedup_by_hash(rows: DataFrame, text: Column, id_column: str) -> DataFrame:
    """content_hash, size and first id of rows of equal content (O8.1)."""
    return rows.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash")).agg(F.count("*").alias("size"), F.min(id_column).alias("first_id"))


def duplicate_links(rows: DataFrame, id_column: str, keys: list[Column]) -> DataFrame:
    """Links of rows that share any of the keys (O9.14): each row with the smallest id of its key's group.

    Instead of an OR join, one pass over the rows writes the keys, each as a hash of 128 bits under its number, and one
    grouping serves all of them; a group of n rows gives n - 1 links, which connect it as all its pairs would. Null keys link
    nothing. Both sides of the join are written tables, so that a key that a third of all rows share can be split.
    """
    rows = rows.select(F.col(id_column).alias("id"), *[k.alias(f"key_{i}") for i, k in enumerate(keys)])  # each key once
    hashed = [F.when(F.col(f"key_{i}").isNotNull(), F.struct(F.lit(i).alias("key"), F.xxhash64(F.lit(1), f"key_{i}").alias("a"), F.xxhash64(F.lit(2), f"key_{i}").alias("b"))) for i in range(len(keys))]
    keyed = rows.select("id", F.explode(F.array_compact(F.array(*hashed))).alias("k")).select("id", "k.*")
    keyed = stored(keyed, "duplicate-keys")
    low = stored(keyed.groupBy("key", "a", "b").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "duplicate-groups")
    return keyed.join(low, ["key", "a", "b"]).where("id <> low").select("low", "id").distinct()


def changed_fields(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows after a key's first one that differ from the row before in any field, with the fields' names and a revision (O5.4, O5.5).

    Null and empty count as equal.
    """
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.withColumn("rn", first).withColumns({f"was_{c}": F.lag(value(c)).over(w) for c in fields})
    diff = F.array_compact(F.array(*[F.when(value(c) != F.col(f"was_{c}"), F.lit(c)) for c in fields]))
    rows = rows.withColumn("changed", diff).where((F.col("rn") > 1) & (F.size("changed") > 0))
    return rows.withColumn("revision", F.row_number().over(w) + 1).drop("rn", *[f"was_{c}" for c in fields])


def upsert(
    current: DataFrame, incoming: DataFrame, key: list[str], fields: list[str], ts: str, order: str, suppressed: DataFrame, valid: Column, page: str | None = None, bucket: str = "day",
) -> tuple[DataFrame, DataFrame]:
    """What a batch does, row by row in the order of (ts, order), and the table after it (O8.2).

    The first result is ``incoming`` with outcome, changed (names of fields) and revision. A row that isn't ``valid`` is
    rejected, one whose first key column is among ``suppressed`` is suppressed; neither leaves a trace. The others are compared
    with the last accepted row of their key before them, in the batch or else in ``current``: created if there is none, updated if
    a field differs (null and empty are equal) or a smaller ``page`` turned up, else unchanged. The second result is the new
    snapshot: key, fields, page, revision, first_seen, last_seen, changed_at. ``current`` has the same columns.

    The last accepted row, the smallest page and the number of changes are carried over from ``bucket`` to bucket, so a key with a third
    of all rows is worked on in parts.
    """
    pages = [page] if page else []
    stop = suppressed.select(F.col(suppressed.columns[0]).alias("up_stop")).distinct()
    rows = incoming.join(stop, F.col(key[0]) == F.col("up_stop"), "left")
    refused = F.when(~F.coalesce(valid, F.lit(False)), "rejected").when(F.col("up_stop").isNotNull(), "suppressed")
    rows = rows.withColumn("up_refused", refused).drop("up_stop")
    ok, cut = F.col("up_refused").isNull(), F.date_trunc(bucket, ts)
    before = {"up_before": ("last", F.when(ok, F.struct(*fields)))} | ({"up_page": ("min", F.when(ok, F.col(page)))} if page else {})
    rows = carried(rows, key, cut, [ts, order], before, own=False)
    old = current.select(*[F.col(c).alias(f"up_key_{i}") for i, c in enumerate(key)], F.struct(*fields).alias("up_old"), *[F.col(c).alias("up_old_page") for c in pages], F.col("revision").alias("up_old_revision"))
    rows = rows.join(old, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"up_key_{i}")) for i, c in enumerate(key)]), "left")
    was = F.coalesce("up_before", "up_old")
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    differs = [F.when(text(F.col(c)) != text(was[c]), F.lit(c)) for c in fields]
    if page:
        least = F.least("up_page", "up_old_page")
        differs.append(F.when(F.col(page).isNotNull() & (least.isNull() | (F.col(page) < least)), F.lit(page)))
    changed = F.when(ok & was.isNotNull(), F.array_compact(F.array(*differs))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("changed", changed)
    outcome = F.coalesce("up_refused", F.when(was.isNull(), "created").when(F.size("changed") > 0, "updated").otherwise("unchanged"))
    rows = rows.withColumn("outcome", outcome)
    moved = F.col("outcome").isin("created", "updated")
    rows = carried(rows, key, cut, [ts, order], {"up_moves": ("count", F.when(moved, 1))})
    rows = rows.withColumn("revision", F.when(ok, F.coalesce("up_old_revision", F.lit(0)) + F.col("up_moves")).cast("long"))
    outcomes = rows.select(*incoming.columns, "outcome", "changed", "revision")

    at = F.struct(ts, order)
    new = rows.where(ok).groupBy(*key).agg(
        F.max_by(F.struct(*fields), F.when(moved, at)).alias("up_fields"), *[F.min(c).alias("up_new_page") for c in pages], F.max("revision").alias("up_revision"), F.min(ts).alias("up_first"), F.max(ts).alias("up_last"), F.max(F.when(moved, F.col(ts))).alias("up_changed"),
    )
    have = current.select(*[F.col(c).alias(f"up_key_{i}") for i, c in enumerate(key)], F.struct(*fields, *pages, "revision", "first_seen", "last_seen", "changed_at").alias("up_have"))
    both = have.join(new, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"up_key_{i}")) for i, c in enumerate(key)]), "full_outer")
    have, is_new = F.col("up_have"), F.col("up_have").isNull()
    keys = [F.when(is_new, F.col(c)).otherwise(F.col(f"up_key_{i}")).alias(c) for i, c in enumerate(key)]
    snapshot = both.select(
        *keys, *[F.when(F.col("up_fields").isNotNull(), F.col("up_fields")[c]).otherwise(have[c]).alias(c) for c in fields], *[F.least(have[c], F.col("up_new_page")).alias(c) for c in pages],
        F.coalesce("up_revision", have["revision"]).alias("revision"), F.coalesce(have["first_seen"], F.col("up_first")).alias("first_seen"), F.greatest(have["last_seen"], F.col("up_last")).alias("last_seen"),
        F.greatest(have["changed_at"], F.col("up_changed")).alias("changed_at"),
    )
    return outcomes, snapshot


def reconcile(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """A full outer reconcile of key sets (O7.4): insert, refresh or disable."""
    e, i = existing.select(key).distinct().withColumn("e", F.lit(True)), incoming.select(key).distinct().withColumn("i", F.lit(True))
    outcome = F.when(F.col("e").isNull(), "insert").when(F.col("i").isNull(), "disable").otherwise("refresh")
    return e.join(i, key, "full_outer").select(key, outcome.alias("outcome"))


def media_reconcile(existing: DataFrame, incoming: DataFrame, complete: DataFrame, key: str, item: str) -> DataFrame:
    """Which items of a key are current after a batch (O8.4): those of the batch, and where the batch was not complete the old ones too."""
    e, i = existing.select(key, item).distinct().withColumn("e", F.lit(True)), incoming.select(key, item).distinct().withColumn("i", F.lit(True))
    joined = e.join(i, [key, item], "full_outer").join(complete.select(key, "complete"), key, "left")
    outcome = F.when(F.col("e").isNull(), "inserted").when(F.col("i").isNotNull(), "refreshed").when(F.coalesce("complete", F.lit(False)), "retired").otherwise("kept")
    return joined.select(key, item, outcome.alias("outcome"), (outcome != "retired").alias("current"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The first incoming row of each key that isn't there yet (O8.5)."""
    rest = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")
    return first.join(existing.select(key), key, "left_anti")


def merged_pages(rows: DataFrame, key: str, order: list[str], fingerprint: Column, value: Column, most: int) -> DataFrame:
    """values and limit_reached of each key (O10.13): over all pages, in ``order``, the first value of each fingerprint, up to ``most``.

    The fingerprint of a list's item is its canonical JSON, that of a pair its key. Equal items are combined in each task, and no
    more than ``most`` of a task's come together.
    """
    rows = rows.select(key, F.struct(*order).alias("at"), fingerprint.alias("print"), value.alias("value"))
    first = rows.groupBy(key, "print").agg(F.min("at").alias("at"), F.min_by("value", "at").alias("value"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("n") <= most)
    out = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("v"))  # ``most`` at most
    return out.select(key, F.transform("v", lambda x: x["value"]).alias("values"), (F.size("v") >= most).alias("limit_reached"))


def unreferenced(listing: DataFrame, key: str, references: DataFrame, modified: str | None = None, now: Column | None = None, grace: str = "24 HOURS") -> DataFrame:
    """Stored keys that no column of ``references`` holds (O1.17, O7.3); where ``modified`` is given, only those that were
    last written longer than ``grace`` before ``now``, so that what is just being written stays. A null time is kept out."""
    columns = references.columns
    refs = references.unpivot([], columns, "column", "ref").where("ref is not null").select("ref").distinct()
    if modified:
        listing = listing.where(F.col(modified) < now - F.expr(f"INTERVAL {grace}"))
    return listing.join(refs, F.col(key) == F.col("ref"), "left_anti")
