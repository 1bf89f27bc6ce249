"""As-of and interval joins without a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import carried


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: list[str], left_order: str | None = None, right_order: str | None = None,
    forward: bool = False, bucket: str = "day", within: str | None = None,
) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` at or before it with the same keys (``forward``: the first one
    at or after it), null where there is none, or none ``within`` an interval such as "1 HOUR".

    Both sides are one union in the order of time, in which the last row of ``right`` is carried on, bucket by bucket, so
    that a key with a third of all rows is worked on in as many parts as it has buckets. Equal times are told apart by
    ``left_order`` and ``right_order``, a null one being the first; without ``left_order`` they match, and of several rows of ``right``
    the one with the largest ``right_order`` counts (``forward``: the smallest). Null keys match null keys; rows of ``right``
    without a time match nothing, and rows of ``left`` without one get nulls.
    """
    own = [f"left_{c}" for c in left.columns]
    kind = right.schema[right_order].dataType if right_order else "int"
    none = F.lit(None).cast(kind)
    here, there = (0, 1) if forward else (1, 0)  # at equal places what is matched comes first
    value = F.struct(F.col(right_at).alias("at"), *[F.col(c) for c in columns])
    r = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("asof_at"), F.lit(there).alias("asof_side"), (F.col(right_order) if right_order else none).alias("asof_order"), value.alias("asof_value"))
    l = left.select(*keys, F.col(left_at).alias("asof_at"), F.lit(here).alias("asof_side"), (F.col(left_order) if left_order else none).alias("asof_order"), F.struct(*[F.col(c).alias(o) for c, o in zip(left.columns, own)]).alias("asof_row"))
    order = ["asof_at", "asof_order", "asof_side"] if left_order else ["asof_at", "asof_side", "asof_order"]
    both = carried(r.unionByName(l, allowMissingColumns=True), keys, F.date_trunc(bucket, "asof_at"), order, {"asof_value": ("first" if forward else "last", F.col("asof_value"))}, ahead=forward)
    hit = F.col("asof_at").isNotNull() & F.col("asof_value").isNotNull()
    if within:
        gap = (F.col("asof_value.at") - F.col("asof_at")) if forward else (F.col("asof_at") - F.col("asof_value.at"))
        hit &= gap <= F.expr(f"INTERVAL {within}")
    rows = both.where(F.col("asof_row").isNotNull())
    return rows.select(*[F.col(f"asof_row.{o}").alias(c) for c, o in zip(left.columns, own)], *[F.when(hit, F.col(f"asof_value.{c}")).alias(c) for c in columns])


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """``points`` with each of the ``spans`` of the same keys that holds them: start <= at < end.

    Spans are put into classes by their length, each twice as long as the one before, and a class has buckets as long as
    its longest span: so a span lies in two buckets at most, however long it is, and a point in one of each class that
    there is (64 at most). Points and spans meet by keys, class and bucket alone, in a merge join: neither side is broadcast, as
    Spark's estimate of a side's size doesn't know how many buckets a row got. Columns of both sides must have different names
    but for the keys. Empty spans hold nothing; ``how`` is inner, left_semi or left_anti.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = spans.withColumns({"span_start": micros(start), "span_end": micros(end)}).where("span_end > span_start")
    spans = spans.withColumn("span_class", F.greatest(F.lit(0), F.ceil(F.log2(F.col("span_end") - F.col("span_start")))).cast("int"))
    width = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    bucket = lambda t, c: F.floor(t / width(c)).cast("long")
    classes = sorted(r[0] for r in spans.select("span_class").distinct().collect())  # 64 numbers at most
    first, last = bucket(F.col("span_start"), F.col("span_class")), bucket(F.col("span_end") - 1, F.col("span_class"))
    spans = spans.withColumn("span_bucket", F.explode(F.sequence(first, last)))
    named = points.withColumns({"point_at": micros(at), "point_row": F.monotonically_increasing_id()}) if how != "inner" else points.withColumn("point_at", micros(at))
    each = named.withColumn("point_class", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumn("point_bucket", bucket(F.col("point_at"), F.col("point_class")))
    renamed = spans.select(*[F.col(c).alias(f"span_key_{i}") for i, c in enumerate(keys)], *[c for c in spans.columns if c not in keys]).hint("merge")
    same = [F.col(c).eqNullSafe(F.col(f"span_key_{i}")) for i, c in enumerate(keys)]
    same += [F.col("point_class") == F.col("span_class"), F.col("point_bucket") == F.col("span_bucket"), F.col("point_at") >= F.col("span_start"), F.col("point_at") < F.col("span_end")]
    if how == "inner":
        met = each.join(renamed, same)
        return met.select(*points.columns, *[c for c in spans.columns if c not in (*keys, "span_start", "span_end", "span_class", "span_bucket")])
    hit = each.join(renamed, same, "left_semi").select("point_row").distinct() if classes else each.select("point_row")
    return named.join(hit, "point_row", how).select(*points.columns)
