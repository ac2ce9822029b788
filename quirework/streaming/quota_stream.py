"""Quota marking on a live request stream, in the order of the requests' own times."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirework.operators.quota import LIMIT, WINDOW_SECONDS, _mark_light

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 minutes"

# Keys are dealt into so many slots; a stream keeps this number for as long as its checkpoint lives.
SLOTS = 128


class QuotaProcessor(StatefulProcessor):
    """Per slot of keys: the requests that still wait for earlier ones, and the windows open at the watermark.

    A timer at the earliest waiting request fires when the watermark has passed it. Then no earlier request
    can come any more, and all of the slot that the watermark has passed are decided in order of time and id.
    A call to the state store moves the rows of all keys of a slot, so calls follow slots and batches, not keys.
    """

    def __init__(self, limit: int, window: int, key_type: str) -> None:
        self.limit, self.window, self.key_type = limit, window, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"keys array<{self.key_type}>, event_ids array<bigint>, times array<bigint>")
        self.open = handle.getValueState("open", f"keys array<{self.key_type}>, opened array<bigint>, used array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            # only the keys of the slot below zero are null
            keys = batch["key"].tolist() if key[0] >= 0 else [None] * len(batch)
            self.waiting.appendValue((keys, batch["event_id"].tolist(), batch["t"].tolist()))
            least = int(batch["t"].min())
            earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self.wake(earliest)
        yield from ()

    def wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        keys, events, t = _columns(self.waiting.get() if self.waiting.exists() else ())
        due = t <= passed
        if not due.all():
            later = ~due
            self.waiting.put([(keys[later].tolist(), events[later].tolist(), t[later].tolist())])
            self.wake(int(t[later].min()))
        elif len(t):
            self.waiting.clear()
        open_keys, opened, used = _columns([self.open.get()] if self.open.exists() else ())
        decided, windows = self.decide(keys[due], events[due], t[due], open_keys, opened, used)
        going = windows["opened"] + self.window > passed  # a window that is over: whatever comes next opens one of its own
        if going.any():
            windows = windows[going]
            self.open.update(tuple(windows[c].tolist() for c in ("key", "opened", "used")))
            self.wake(int(windows["opened"].min()) + self.window)
        elif len(opened):
            self.open.clear()
        if len(decided):
            yield decided

    def decide(self, keys, events, t, open_keys, opened, used) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Marks of the due requests, and the last window of every key; an open window stands before its requests as a row at its start."""
        n = len(open_keys)
        every = np.concatenate([open_keys, keys])
        code = pd.factorize(every, use_na_sentinel=False)[0]
        at, event = np.concatenate([opened, t]), np.concatenate([np.zeros(n, dtype=np.int64), events])
        counted = np.concatenate([used, np.ones(len(t), dtype=np.int64)])
        request = np.arange(len(every)) >= n
        order = np.lexsort((event, request, at, code))
        code, at, event, request = code[order], at[order], event[order], request[order]
        first = _mark_light(code, at, self.window) if len(order) else np.empty(0, dtype=np.int64)
        turn = np.arange(len(order)) - first + counted[order][first]
        allowed = turn <= self.limit
        wait = np.where(allowed, 0, self.window - (at - at[first]))
        marked = pd.DataFrame({"key": every[order], "event_id": event, "t": at, "allowed": allowed, "wait_micros": wait})
        last = np.append(code[1:] != code[:-1], True)[: len(order)]
        windows = pd.DataFrame({"key": every[order][last], "opened": at[first][last], "used": np.minimum(turn, self.limit + 1)[last]})
        return marked[request], windows

    def close(self) -> None:
        pass


def _columns(pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and two columns of whole numbers, of pieces that hold each as a list."""
    keys, left, right = [], [], []
    for k, a, b in pieces:
        keys += k
        left += a
        right += b
    named = np.empty(len(keys), dtype=object)
    named[:] = keys
    return named, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def mark_quota_stream(
    events: DataFrame,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    lateness: str = LATENESS,
    slots: int = SLOTS,
) -> DataFrame:
    """The streaming form of ``mark_quota`` over (key, ts, event_id) rows.

    A request waits until the watermark, the newest time seen less ``lateness``, has passed it; so answers are
    those of ``mark_quota``, whatever order requests arrive in within the lateness. One that is later than
    that is dropped by the watermark and gets no row. A key whose window is over and that has nothing waiting
    leaves no state. Keys share ``slots``, whose rows between two watermarks one task holds at a time; null has
    a slot of its own. The query needs the RocksDB state store (``STATE_STORE``, ``ROCKS_DB``).
    """
    key_type = dict(events.dtypes)["key"]
    timed = (
        events.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"))
        .withWatermark("ts", lateness)
        .withColumn("t", F.unix_micros("ts"))
    )
    slot = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(slots))).cast("int")
    marked = timed.withColumn("slot", slot).groupBy("slot").transformWithStateInPandas(
        statefulProcessor=QuotaProcessor(limit, window_seconds * 1_000_000, key_type),
        outputStructType=f"key {key_type}, event_id bigint, t bigint, allowed boolean, wait_micros bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    retry_after = F.when(~F.col("allowed"), F.col("wait_micros") / 1e6)
    return marked.select(
        "key", "event_id", F.timestamp_micros("t").alias("ts"), "allowed", retry_after.alias("retry_after")
    )
