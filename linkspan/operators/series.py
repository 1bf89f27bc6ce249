"""Rates, quantiles and running sums over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .carry import carried


def window_counts(rows: DataFrame, ts: str, width: str, keys: list[str] = (), slide: str | None = None, **counts: Column) -> DataFrame:
    """Counts by event-time window and keys (O12.5, O12.14): start, keys, then one column for each condition."""
    w = F.window(ts, width, slide).alias("w") if slide else F.window(ts, width).alias("w")
    out = rows.groupBy(w, *keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return out.select(F.col("w.start").alias("start"), *keys, *counts)


def increase(rows: DataFrame, key: str, ts: str, order: str, counter: str) -> DataFrame:
    """What a counter gained since its row before; a drop is a restart from zero (O12.11).

    The last value is carried over from day to day, so a key's history is worked on in parts; a null counter gains nothing.
    """
    rows = carried(rows, [key], F.date_trunc("day", ts), [ts, order], {"counter_before": ("last", F.col(counter))}, own=False)
    before = F.col("counter_before")
    gain = F.when(before.isNull() | F.col(counter).isNull(), 0).when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before)
    return rows.withColumn("gain", gain).drop("counter_before")


def bucket_quantile(buckets: DataFrame, keys: list[str], bound: str, cumulative: str, q: float, name: str) -> DataFrame:
    """A quantile from cumulative buckets by linear interpolation (O12.13); one that falls into an infinite bucket is the
    largest bound below it."""
    w = Window.partitionBy(*keys).orderBy(bound)
    rows = buckets.withColumns({"total": F.max(cumulative).over(Window.partitionBy(*keys)), "below": F.coalesce(F.lag(cumulative).over(w), F.lit(0)), "low": F.coalesce(F.lag(bound).over(w), F.lit(0.0))})
    rank = F.col("total") * q
    hit = rows.where((F.col(cumulative) >= rank) & (F.col("below") < rank))
    inside = F.col("low") + (F.col(bound) - F.col("low")) * (rank - F.col("below")) / (F.col(cumulative) - F.col("below"))
    value = F.when(F.col(bound) == float("inf"), F.col("low")).otherwise(inside)
    return hit.groupBy(*keys).agg(half_up(F.min(value), 6).alias(name))


def quantiles(rows: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """Exact quantiles of each group by linear interpolation (O12.13), rounded to four digits.

    Equal values are counted in each task first; a group is ordered by its distinct values alone. Nulls don't count.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    counted = counted.withColumns({"upto": F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col(value)))

    place = {name: (F.col("total") - 1) * q for name, q in shares.items()}
    ends = [e for name, p in place.items() for e in (at(F.floor(p)).alias(f"{name}_low"), at(F.ceil(p)).alias(f"{name}_high"))]
    out = counted.groupBy(*keys, "total").agg(*ends)
    between = lambda name: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place[name] - F.floor(place[name]))
    return out.select(*keys, *[half_up(between(name), 4).alias(name) for name in shares])
