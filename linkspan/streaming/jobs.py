"""Structured Streaming jobs. Each takes a streaming DataFrame and gives one, or starts a query."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.numbers import COOLDOWN_MINUTES


def read_events(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet files of a folder or glob as a stream; ``ts`` becomes a TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are dropped (O12.5, O12.14, O12.18)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def dedup(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key while the watermark remembers it (O8.1, O8.5)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """Sessions that end after a gap (O12.4, O12.19)."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class _Sessions(StatefulProcessor):
    """Open sessions (key, start, end, rows, times in microseconds) of a share of all keys as one value of four arrays in state, and a timer
    at the first moment when one of them is over.

    What a call costs (a frame, a state read and written, a timer) comes once a share and micro-batch, not once a key or session.
    """

    _NAMES = ("key", "start_us", "end_us", "n")
    _MANY = 1 << 16

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", ", ".join(f"{c} array<long>" for c in self._NAMES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, new = self._held(), []
        for chunk in rows:  # in any order; merged now and then, so that a share of any size needs no more memory than its open sessions
            new.append(self._merged(pd.DataFrame({"key": chunk["key"], "start_us": chunk["us"], "end_us": chunk["us"], "n": 1})))
            if sum(map(len, new)) > max(self._MANY, len(found)):
                found, new = self._merged(pd.concat([found, *new])), []
        self._hold(self._merged(pd.concat([found, *new])))
        return iter(())

    def _held(self) -> pd.DataFrame:
        held = self.open.get() or [[]] * len(self._NAMES)
        return pd.DataFrame({c: np.asarray(x, dtype="int64") for c, x in zip(self._NAMES, held)})

    def _hold(self, found: pd.DataFrame) -> None:
        if found.empty:
            self.open.clear()
            return
        self.open.update(tuple(found[c].tolist() for c in self._NAMES))
        self.handle.registerTimer(-(-(int(found["end_us"].min()) + self.gap) // 1000))

    def _merged(self, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["key", "start_us"], ignore_index=True)
        if found.empty:
            return found
        last = found.groupby("key")["end_us"].cummax().to_numpy()  # the latest end so far
        fresh = (np.diff(found["key"].to_numpy()) != 0) | (found["start_us"].to_numpy()[1:] - last[:-1] > self.gap)
        at = np.flatnonzero(np.r_[True, fresh])
        ends = np.r_[at[1:], len(found)] - 1
        return pd.DataFrame({"key": found["key"].to_numpy()[at], "start_us": found["start_us"].to_numpy()[at], "end_us": last[ends], "n": np.add.reduceat(found["n"].to_numpy(), at)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self._held()
        over = -(-(found["end_us"] + self.gap) // 1000) <= timerValues.getCurrentWatermarkInMs()
        if over.any():  # else what the timer was for has gone on since
            self._hold(found[~over])
            yield found[over].assign(share=key[0])

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, gap_seconds: int, late: str, shares: int = 256) -> DataFrame:
    """Sessions (user_id, start, end, n) that ended because nothing came for ``gap_seconds`` (O12.4): an event-time timer closes each.

    ``events`` has user_id and ts; rows without a time belong to no session. Rows that are later than ``late`` behind the latest one before the
    last batch are dropped and counted in the query's progress; others may come in any order and join sessions that were apart. State is the
    open sessions in RocksDB, those of all users of one of ``shares`` hashes together; so that many tasks work at most. Rows without a user are one
    more share.
    """
    share = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.hash("user_id"), F.lit(shares)))
    rows = events.where("ts is not null").select(share.alias("share"), F.coalesce("user_id", F.lit(0)).cast("long").alias("key"), "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    out = rows.groupBy("share").transformWithStateInPandas(_Sessions(gap_seconds * 1_000_000), "key long, start_us long, end_us long, n long, share int", "append", "eventTime")
    return out.select(F.when(F.col("share") >= 0, F.col("key")).alias("user_id"), F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "n")


class _Budget(StatefulProcessor):
    """What a key has reserved, as one number in state, forgotten by a timer when the key's budget is over."""

    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()[0] if self.held.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["us", "id"])  # one key of one micro-batch
        fits, reserved = [], []
        for amount in batch["amount"].tolist():
            ok = amount <= 0 or held + amount <= self.most
            held = max(held + amount, 0) if ok else held
            fits.append(ok)
            reserved.append(held)
        self.held.update((held,))
        self.handle.registerTimer(int(batch["us"].iloc[-1] // 1000) + self.keep)
        yield pd.DataFrame({"key": key[0], "id": batch["id"], "fits": fits, "reserved": reserved})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, most: int, late: str = "1 hour", keep_hours: int = 48) -> DataFrame:
    """The continuous form of ``limits.admitted`` (O12.5): key, id, fits and reserved of ``requests`` (key, id, ts, amount) as they come.

    A refused request leaves no trace; a negative amount gives back what was reserved and not used. Rows of one micro-batch are put in
    order, those of later ones count as they come; a key is forgotten ``keep_hours`` after its last request of a micro-batch, when its day is
    over.
    """
    rows = requests.select("key", "id", "amount", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Budget(most, keep_hours * 3_600_000), "key string, id long, fits boolean, reserved long", "append", "eventTime")


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, int]:
    """What a stream gives when all that is there has been read, and how many rows came too late."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    dropped = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(path), dropped


_COOLDOWN = "user_id long, event_id long, failures long, cooldown_until timestamp"


def _cooldown(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, forget_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    before = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one key of one micro-batch
    failed = rows["event_type"] == "error"
    streak = (~failed).cumsum()  # 0 as long as the streak of the batch before goes on
    failures = failed.astype("int64").groupby(streak).cumsum() + (streak == 0) * before
    minutes = failures.clip(upper=len(COOLDOWN_MINUTES)).map(lambda n: COOLDOWN_MINUTES[n - 1] if n else None)
    until = (rows["ts"] + pd.to_timedelta(minutes.astype("float64"), unit="min")).where(failed)
    state.update((int(failures.iloc[-1]),))
    state.setTimeoutTimestamp(max(int(rows["ts"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + forget_ms)
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "failures": failures, "cooldown_until": until})


def cooldowns(events: DataFrame, late: str = "1 day", forget_hours: int = 24) -> DataFrame:
    """Failure streaks and rests as events (user_id, event_id, ts, event_type) arrive (O12.7): one number of state a key.

    Rows later than ``late`` behind the latest one are dropped; rows of one micro-batch are put in order, those of later
    ones count as they come. A key that was silent for ``forget_hours`` of event time behind the watermark is forgotten:
    its longest rest is over by then and its streak starts anew.
    """
    run = partial(_cooldown, forget_ms=forget_hours * 3_600_000)
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, _COOLDOWN, "failures long", "append", GroupStateTimeout.EventTimeTimeout)


def publish(events: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch once under its number, so that a repeated batch replaces itself (O8.7, O12.1)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
