"""Control of jobs as stateful streams: a budget a day and a ring of the last outcomes, by user. Both need the RocksDB state store (see rocksdb()).

A call or a piece of state for each user costs milliseconds, so the streams are keyed by BUCKETS hashes of users: a batch takes all users of a bucket at once, as arrays,
and their state is read and written once. Users without events in a batch keep theirs. The number of buckets is fixed by the checkpoint; raise it for more users.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUDGET, RING, MOST_ERRORS = 2, 50, 5
BUCKETS = 128
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def _by_user(rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by user and time; the users, ascending, with their first place and number of rows."""
    rows = pd.concat(list(rows)).sort_values(["who", "at", "event_id"])
    return rows, *np.unique(rows["who"].to_numpy(), return_index=True, return_counts=True)


def _looked_up(state: tuple | None, users: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a state (users, ascending, and values, as bytes) has for users (0: nothing), and its rows of other users."""
    if state is None:
        return np.zeros(len(users), kind), np.zeros(0, np.int64), np.zeros(0, kind)
    known, values = np.frombuffer(state[0], np.int64), np.frombuffer(state[1], kind)
    at = np.minimum(np.searchsorted(known, users), len(known) - 1)
    other = ~np.isin(known, users)
    return np.where(known[at] == users, values[at], 0).astype(kind), known[other], values[other]


def _state(users: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    order = np.argsort(users)
    return users[order].tobytes(), values[order].tobytes()


class DailyBudget(StatefulProcessor):
    """Lets BUDGET events of a user and day through. What the users of a bucket have used of a day, named by its end, is a map entry; a timer at the end of the day
    removes it, once the watermark says that no event of it can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "ends long", "users binary, n binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = []
        for ends, day in pd.concat(list(rows)).groupby("ends"):
            ends, (own, users, start, n) = int(ends), _by_user([day])
            state = self.used.getValue((ends,)) if self.used.containsKey((ends,)) else None
            before, others, theirs = _looked_up(state, users, np.int8)
            place = np.arange(len(own)) - np.repeat(start, n) + np.repeat(before, n)
            kept.append(own[place < BUDGET])
            if state is None:
                self.handle.registerTimer(ends)
            now = np.minimum(before + n, BUDGET).astype(np.int8)
            self.used.updateValue((ends,), _state(np.append(others, users), np.append(theirs, now)))
        yield pd.concat(kept)[["event_id", "who"]].assign(bucket=key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends = expiredTimerInfo.getExpiryTimeInMs()
        if self.used.containsKey((ends,)):
            self.used.removeKey((ends,))
        yield pd.DataFrame({"event_id": [], "who": [], "bucket": []}, dtype="int64")

    def close(self) -> None:
        pass


class ErrorRing(StatefulProcessor):
    """For each event of a user whether MOST_ERRORS or more of the last RING events, itself included, are errors. The rings of a bucket's users are one value, RING bits each, the latest lowest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rings = handle.getValueState("rings", "users binary, rings binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows, users, start, n = _by_user(rows)
        before, others, theirs = _looked_up(self.rings.get(), users, np.uint64)
        powers = np.arange(RING - 1, -1, -1, dtype=np.uint64)
        # each user's RING flags of before, oldest first, then those of the rows
        begin = start + np.arange(len(users)) * RING
        flags = np.zeros(len(rows) + len(users) * RING, np.int64)
        flags[begin[:, None] + np.arange(RING)] = (before[:, None] >> powers) & np.uint64(1)
        at = np.arange(len(rows)) + np.repeat(np.arange(1, len(users) + 1) * RING, n)
        flags[at] = rows["event_type"].to_numpy() == "error"
        sums = np.append(0, np.cumsum(flags))
        errors = sums[at + 1] - sums[at + 1 - RING]
        last = flags[(begin + n)[:, None] + np.arange(RING)].astype(np.uint64)
        self.rings.update(_state(np.append(others, users), np.append(theirs, (last << powers).sum(1, dtype=np.uint64))))
        yield rows[["event_id", "who"]].assign(bucket=key[0], errors=errors, degraded=errors >= MOST_ERRORS)

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, *columns: Column | str) -> DataFrame:
    """Rows with their user's bucket; those without a user have one of their own."""
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))).cast("long").alias("bucket")
    return stream.select("event_id", F.coalesce("user_id", F.lit(0)).cast("long").alias("who"), F.unix_micros("ts").alias("at"), bucket, *columns)


def _user() -> Column:
    return F.when(F.col("bucket") >= 0, F.col("who")).alias("user_id")


def throttled(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """event_id, user_id of the first BUDGET events of each user and day of a stream (event_id, user_id, ts) whose batches follow each other in time."""
    keyed = _keyed(stream.withWatermark("ts", late), "ts", F.unix_millis(F.date_add(F.to_date("ts"), 1).cast("timestamp")).alias("ends"))
    return keyed.groupBy("bucket").transformWithStateInPandas(DailyBudget(), "event_id long, who long, bucket long", "Append", "EventTime").select("event_id", _user())


def degraded(stream: DataFrame) -> DataFrame:
    """event_id, user_id, errors, degraded of a stream (event_id, user_id, event_type, ts) whose batches follow each other in time."""
    out = _keyed(stream, "event_type").groupBy("bucket").transformWithStateInPandas(ErrorRing(), "event_id long, who long, bucket long, errors long, degraded boolean", "Append", "None")
    return out.select("event_id", _user(), "errors", "degraded")
