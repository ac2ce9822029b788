"""Request quota over a log: fixed windows anchored at a key's first counted request.

A window opens at the first request at or after the end of the former one, so windows of a
key form a chain. Keys with few requests are hashed into slots of bounded size and all
chains of a slot advance together. The chain of a heavy key is found without putting its
history into one task:

1. Time is cut into buckets no shorter than a window. Inside one bucket the last window start
   reached from each possible first start is worked out for (key, bucket) alone.
2. Neighbouring buckets are merged, ``FAN_IN`` at a time, until one node spans the log; a
   node keeps only starts within one window of its beginning.
3. Going down again, each node tells its children the earliest time a window may open.
4. Every bucket then lists its own window starts; a window's first requests are found by partial ranks.

A key with a third of all rows is spread over its buckets in every step.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quirework.functions.common import broadcast_within_bound, fits_broadcast, materialize

# Allowed requests and window length.
LIMIT = 10
WINDOW_SECONDS = 60

BUCKET_WINDOWS = 16
FAN_IN = 64
LIGHT_ROWS = 20_000
SLOT_ROWS = 100_000
_NEVER = np.iinfo(np.int64).min // 2


def _last_start(times: np.ndarray, window: int) -> np.ndarray:
    """For each time taken as a window start, the last start its chain reaches."""
    following = np.searchsorted(times, times + window)
    reach = np.where(following < len(times), following, np.arange(len(times)))
    while True:
        further = reach[reach]
        if np.array_equal(further, reach):
            return times[reach]
        reach = further


def _first_from(entries: np.ndarray, exits: np.ndarray, earliest: np.ndarray, stay: np.ndarray):
    """Exit reached from the first entry at or after ``earliest``; ``stay`` where there is none."""
    at = np.searchsorted(entries, earliest)
    inside = at < len(entries)
    return np.where(inside, exits[np.minimum(at, len(entries) - 1)], stay)


def _children(pdf: pd.DataFrame):
    """(node, entries, exits) of each child node in time order."""
    ordered = pdf.sort_values(["child", "entry"])
    for child, part in ordered.groupby("child", sort=True):
        yield child, part["entry"].to_numpy(), part["exit"].to_numpy()


def _mark_light(keys: np.ndarray, t: np.ndarray, window: int) -> np.ndarray:
    """Row at which the window of each row opened; rows are sorted by key code, then time."""
    n = len(t)
    # rows before (key, t + window) in one joint order: the first row past each window
    is_row = np.repeat([0, 1], n)
    order = np.lexsort((is_row, np.concatenate([t + window, t]), np.concatenate([keys, keys])))
    past = np.empty(n, dtype=np.int64)
    before = np.cumsum(is_row[order])
    targets = order < n
    past[order[targets]] = before[targets]

    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    opens = np.zeros(n, dtype=bool)
    while len(at):
        opens[at] = True
        to = past[at]
        stays = to < n
        stays[stays] = keys[to[stays]] == keys[at[stays]]
        at = to[stays]
    return np.maximum.accumulate(np.where(opens, np.arange(n), 0))


def mark_quota(
    events: DataFrame,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    bucket_windows: int = BUCKET_WINDOWS,
    fan_in: int = FAN_IN,
    light_rows: int = LIGHT_ROWS,
) -> DataFrame:
    """(key, event_id, ts, allowed, retry_after) of (key, ts, event_id) rows; ``retry_after``
    is in seconds and null when allowed.

    Requests of a key are taken in order of ts, then event_id. Denied requests are not
    counted and do not extend the window.
    """
    window = window_seconds * 1_000_000
    timed = events.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    counts = timed.groupBy("key").agg(F.count("*").alias("n"))
    is_heavy = F.col("n") > light_rows
    sizes = counts.agg(
        F.count_if(is_heavy).alias("heavy_keys"),
        F.sum(F.when(~is_heavy, F.col("n"))).alias("light_rows"),
    ).first()

    light = timed
    if sizes["heavy_keys"]:
        heavy_keys = broadcast_within_bound(counts.filter(is_heavy).select("key"))
        light = timed.join(heavy_keys, "key", "left_anti")
    slots = max(1, math.ceil((sizes["light_rows"] or 0) / SLOT_ROWS))
    schema = f"key {dict(events.dtypes)['key']}, event_id bigint, t bigint, opened bigint, turn bigint"

    def mark_slot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "t", "event_id"])
        t = pdf["t"].to_numpy()
        opened_at = _mark_light(pd.factorize(pdf["key"])[0], t, window)
        return pdf[["key", "event_id", "t"]].assign(
            opened=t[opened_at], turn=np.arange(1, len(t) + 1) - opened_at
        )

    slot = F.pmod(F.xxhash64("key"), F.lit(slots)).alias("slot")
    placed = light.groupBy(slot).applyInPandas(mark_slot, schema).withColumn("allowed", F.col("turn") <= limit).drop("turn")
    if sizes["heavy_keys"]:
        heavy = timed.join(heavy_keys, "key", "left_semi")
        chained = materialize(_place_heavy(heavy, window, bucket_windows, fan_in), "quota-placed")
        placed = placed.unionByName(_first_of_windows(chained, limit))
    allowed = F.col("allowed")
    return placed.select(
        "key",
        "event_id",
        F.timestamp_micros("t").alias("ts"),
        allowed,
        F.when(~allowed, (F.lit(window) - (F.col("t") - F.col("opened"))) / 1e6).alias("retry_after"),
    )


def _first_of_windows(chained: DataFrame, limit: int, salts: int = 16) -> DataFrame:
    """Add ``allowed`` to rows with the start of their window: the first ``limit`` of each.

    No task ranks a window. The rank limit works inside each map task before the shuffle, so a window
    sends at most ``limit`` rows per task; the last of the first ``limit`` then decides every row by a
    comparison. Rows of one window are spread over salts where the windows are too many to broadcast.
    """
    turn = Window.partitionBy("key", "opened").orderBy("t", "event_id")
    firsts = chained.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= limit)
    last = materialize(
        firsts.groupBy("key", "opened").agg(F.max(F.struct("t", "event_id")).alias("last"), F.count("*").alias("n")), "quota-last"
    )
    if fits_broadcast(last):
        joined = chained.join(F.broadcast(last), ["key", "opened"])
    else:
        copies = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = chained.withColumn("salt", F.pmod(F.xxhash64("event_id", "t"), F.lit(salts)).cast("int"))
        joined = salted.join(copies, ["key", "opened", "salt"])
    within = (F.col("n") < limit) | (F.struct("t", "event_id") <= F.col("last"))
    return joined.select("key", "event_id", "t", "opened", within.alias("allowed"))


def _place_heavy(timed: DataFrame, window: int, bucket_windows: int, fan_in: int) -> DataFrame:
    """Add ``opened``, the start of the window each request falls into."""
    width = window * bucket_windows
    key_type = dict(timed.dtypes)["key"]
    t = F.col("t")
    timed = timed.withColumn("bucket", ((t - F.pmod(t, F.lit(width))) / F.lit(width)).cast("bigint"))
    times = materialize(timed.select("key", "bucket", "t").distinct(), "quota-times")
    span = times.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    low, n_buckets = (span["low"], span["high"] - span["low"] + 1) if span["low"] is not None else (0, 1)

    def bucket_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        bucket = int(pdf["bucket"].iat[0])
        n = np.searchsorted(t, bucket * width + window) + 1
        return pd.DataFrame(
            {"key": pdf["key"].iat[0], "node": bucket - low, "entry": t[:n], "exit": _last_start(t, window)[:n]}
        )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = list(_children(pdf))
        _, entries, exits = parts[0]
        rest = parts[1:]
        if rest:
            # every request of the first child may fall into an older window
            exits = _first_from(rest[0][1], rest[0][2], exits + window, exits)
            entries, exits = np.append(entries, rest[0][1][0]), np.append(exits, rest[0][2][0])
        for _, e, x in rest[1:]:
            exits = _first_from(e, x, exits + window, exits)
        return pd.DataFrame(
            {"key": pdf["key"].iat[0], "node": int(pdf["node"].iat[0]), "entry": entries, "exit": exits}
        )

    def hand_down(pieces: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
        earliest = np.array([int(parents["earliest"].iat[0])])
        nodes, starts = [], []
        for child, entries, exits in _children(pieces):
            nodes.append(child)
            starts.append(int(earliest[0]))
            earliest = _first_from(entries, exits, earliest, earliest - window) + window
        return pd.DataFrame({"key": pieces["key"].iat[0], "node": nodes, "earliest": starts})

    def bucket_windows_of(times_of: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(times_of["t"].to_numpy())
        earliest = int(entry["earliest"].iat[0])
        starts = [earliest - window]
        at = np.searchsorted(t, earliest)
        while at < len(t):
            starts.append(int(t[at]))
            at = np.searchsorted(t, t[at] + window)
        return pd.DataFrame(
            {"key": [times_of["key"].iat[0]], "bucket": [int(times_of["bucket"].iat[0])], "starts": [starts]}
        )

    piece_schema = f"key {key_type}, node bigint, entry bigint, exit bigint"
    entry_schema = f"key {key_type}, node bigint, earliest bigint"

    def with_parent(level: DataFrame) -> DataFrame:
        child = F.col("node")
        parent = (child - F.pmod(child, F.lit(fan_in))) / F.lit(fan_in)
        return level.withColumn("child", child).withColumn("node", parent.cast("bigint"))

    # each level is written once: it is merged upwards and read again on the way down
    pieces = times.groupBy("key", "bucket").applyInPandas(bucket_pieces, piece_schema)
    levels = [materialize(pieces, "quota-level")]
    nodes = n_buckets
    while nodes > fan_in:
        merged = with_parent(levels[-1]).groupBy("key", "node").applyInPandas(merge, piece_schema)
        levels.append(materialize(merged, "quota-level"))
        nodes = -(-nodes // fan_in)

    known = times.select("key").distinct().select(
        "key", F.lit(0).cast("bigint").alias("node"), F.lit(_NEVER).alias("earliest")
    )
    for level in reversed(levels):
        known = (
            with_parent(level)
            .groupBy("key", "node")
            .cogroup(known.groupBy("key", "node"))
            .applyInPandas(hand_down, entry_schema)
        )
    known = known.withColumn("bucket", F.col("node") + F.lit(low)).drop("node")

    starts = (
        times.groupBy("key", "bucket")
        .cogroup(known.groupBy("key", "bucket"))
        .applyInPandas(bucket_windows_of, f"key {key_type}, bucket bigint, starts array<bigint>")
    )
    opened = F.array_max(F.filter("starts", lambda s: s <= F.col("t")))
    return timed.join(starts, ["key", "bucket"]).select("key", "event_id", "t", opened.alias("opened"))
