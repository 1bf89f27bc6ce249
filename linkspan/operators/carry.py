"""Prefix computations over ordered rows of a key, in parts that are carried over.

A window over a key that has a third of all rows is one task. Here a key's rows are cut by ``bucket`` (its day, its
hour, its second), each bucket is worked on alone, and what the buckets before it come to, a row for each, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "carry_bucket"


def _whole(how: str, value: Column, at: Column) -> Column:
    """What a bucket comes to."""
    if how in ("last", "first"):
        return (F.max_by if how == "last" else F.min_by)(value, F.when(value.isNotNull(), at))
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[how](value)


def _over(how: str, value: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda v: F.last(v, ignorenulls=True), "first": lambda v: F.last(v, ignorenulls=True)}[how](value)


def carried(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], values: dict[str, tuple[str, Column]], own: bool = True, ahead: bool = False, peers: bool = False) -> DataFrame:
    """``rows`` with, for each name of ``values``, the sum, count, max, min or last non-null value over a key's rows up to each row.

    ``own``: the row itself counts; ``peers``: all rows of equal order count together; ``ahead``: the rows after each row
    instead of those before it (``first`` is then the next non-null value). ``bucket`` must not fall as ``order`` rises.
    Null keys are one key; a null bucket comes first.
    """
    rows = rows.withColumn(_BUCKET, bucket)
    rows = rows.withColumns({f"carry_{n}": v for n, (_, v) in values.items()})
    at = F.struct(*order)
    by = [*keys, _BUCKET]
    parts = rows.groupBy(*by).agg(*[_whole(how, F.col(f"carry_{n}"), at).alias(f"of_{n}") for n, (how, _) in values.items()])
    turn = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    before = Window.partitionBy(*keys).orderBy(turn(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: "sum" if how == "count" else how for n, (how, _) in values.items()}  # counts of buckets are added up
    parts = parts.select(*[F.col(c).alias(f"carry_key_{i}") for i, c in enumerate(by)], *[_over(sums[n], F.col(f"of_{n}")).over(before).alias(f"of_{n}") for n in values])
    frame = Window.partitionBy(*by).orderBy(*map(turn, order))
    if peers:
        frame = frame.rangeBetween(Window.unboundedPreceding, 0)
    else:
        frame = frame.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    rows = rows.withColumns({f"in_{n}": _over(how, F.col(f"carry_{n}")).over(frame) for n, (how, _) in values.items()})
    same = [F.col(c).eqNullSafe(F.col(f"carry_key_{i}")) for i, c in enumerate(by)]
    joined = rows.join(parts, same, "left")

    def both(n: str, how: str) -> Column:
        a, b = F.col(f"of_{n}"), F.col(f"in_{n}")
        if how in ("sum", "count"):
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.greatest(a, b) if how == "max" else F.least(a, b) if how == "min" else F.coalesce(b, a)

    names = [c for c in rows.columns if c not in {_BUCKET, *values, *(f"{p}_{n}" for n in values for p in ("carry", "in"))}]
    return joined.select(*names, *[both(n, how).alias(n) for n, (how, _) in values.items()])
