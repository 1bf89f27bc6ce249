"""Ratios, deltas, durations, buckets and back-off as expressions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of cooldown by consecutive failures, seconds of delivery back-off by attempt.
COOLDOWN_MINUTES = (5, 15, 30, 60)
DELIVERY_SECONDS = (60, 300, 900, 3600, 14400)
VERIFIED = 0.85


def half_up(x: Column, digits: int) -> Column:
    """Half-up rounding by plain double arithmetic, which every engine does alike."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def percentage(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with one digit; 0 if there is no whole (O4.7)."""
    return F.when(whole > 0, half_up(part * 100.0 / F.nullif(whole, F.lit(0)), 1)).otherwise(0.0)


def percentage_delta(now: Column, before: Column) -> Column:
    """Change in percent; from nothing it is 100 or 0 (O4.8)."""
    change = half_up((now - before) * 100.0 / F.nullif(before, F.lit(0)), 1)
    return F.when(before > 0, change).when(now > 0, 100.0).otherwise(0.0)


def confidence_status(confidence: Column) -> Column:
    """verified from 0.85 on; lower or null is unverified (O10.9)."""
    return F.when(confidence >= VERIFIED, "verified").otherwise("unverified")


def step(values: tuple[int, ...], n: Column) -> Column:
    """The n-th value (from 1), the last one beyond (O10.10); null for n < 1."""
    return F.when(n >= 1, F.get(F.array(*map(F.lit, values)), F.least(n, F.lit(len(values))).cast("int") - 1))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds; null while either is missing (O10.5)."""
    return F.timestamp_diff("SECOND", start, end).cast("long")


def duration_text(seconds: Column) -> Column:
    """``Hh Mm`` from an hour on, ``Mm Ss`` below, ``-`` for null (O10.6)."""
    part = lambda x: x.cast("long").cast("string")
    hours = F.concat(part(F.floor(seconds / 3600)), F.lit("h "), part(F.floor(seconds % 3600 / 60)), F.lit("m"))
    minutes = F.concat(part(F.floor(seconds / 60)), F.lit("m "), part(seconds % 60), F.lit("s"))
    return F.when(seconds.isNull(), "-").when(seconds >= 3600, hours).otherwise(minutes)


def local_to_utc(local: Column, zone: str) -> Column:
    """UTC of a local wall time; null where clocks skip it (O10.2)."""
    utc = F.to_utc_timestamp(local.cast("timestamp"), zone)
    return F.when(F.from_utc_timestamp(utc, zone) == local.cast("timestamp"), utc)


@dataclass(frozen=True)
class TimeRange:
    """A half-open range [start, end) (O2.1)."""

    start: datetime
    end: datetime

    @property
    def before(self) -> TimeRange:
        """The range of the same length that ends where this one starts (O2.3)."""
        return TimeRange(self.start - (self.end - self.start), self.start)

    def holds(self, ts: Column) -> Column:
        return (ts >= F.lit(self.start).cast("timestamp_ntz")) & (ts < F.lit(self.end).cast("timestamp_ntz"))


def resolve_range(start: datetime | None, end: datetime | None, now: datetime, most: timedelta = timedelta(days=90)) -> TimeRange:
    """Both bounds or none (the last day), in order, not in the future, ``most`` long at most (O2.2)."""
    if start is None and end is None:
        return TimeRange(now - timedelta(days=1), now)
    if start is None or end is None:
        raise ValueError("a range needs both bounds")
    if start >= end:
        raise ValueError("a range must end after its start")
    if end > now:
        raise ValueError("a range may not end in the future")
    if end - start > most:
        raise ValueError("a range is too long")
    return TimeRange(start, end)


def range_problem(start: Column, end: Column, now: Column, most_days: int = 90) -> Column:
    """The same rules over columns: the reason a range is invalid, or ``valid``."""
    return (
        F.when(start.isNull() & end.isNull(), "valid")
        .when(start.isNull() | end.isNull(), "one bound")
        .when(start >= end, "reversed")
        .when(end > now, "future")
        .when(F.timestamp_diff("SECOND", start, end) > most_days * 86400, "too long")
        .otherwise("valid")
    )
