from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import quota
from quirework.operators.quota import mark_quota
from quirework.streaming.quota_stream import ROCKS_DB, STATE_STORE, mark_quota_stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DDL = "event_id bigint, key string, ts timestamp"


def log(spark, rows):
    return spark.createDataFrame([(i, k, START + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)], DDL)


def expected(rows, limit, window):
    open_, out = {}, {}
    for i, (key, s) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        start, used = open_.get(key, (s, 0))
        if s >= start + window:
            start, used = s, 0
        out[i] = used < limit
        open_[key] = (start, used + out[i])
    return out


def marks(df):
    return {r["event_id"]: r["allowed"] for r in df.collect()}


def test_limit_reset_and_retry_after(spark):
    rows = [("a", 0)] * 10 + [("a", 15), ("b", 15), ("a", 60), ("a", 61)]
    marked = {r["event_id"]: r for r in mark_quota(log(spark, rows)).collect()}
    assert [marked[i]["allowed"] for i in range(14)] == [True] * 10 + [False, True, True, True]
    assert marked[10]["retry_after"] == 45 and marked[9]["retry_after"] is None


@pytest.mark.parametrize("bucket_windows, fan_in", [(2, 5), (16, 64)])
def test_against_brute_force_with_a_hot_key(spark, bucket_windows, fan_in):
    rng = np.random.default_rng(5)
    rows = [("hot", int(s)) for s in rng.integers(0, 4000, 1500)]
    rows += [(f"k{rng.integers(0, 9)}", int(s)) for s in rng.integers(-2000, 6000, 600)]
    for light_rows in (10_000, 100):  # no key, or only the hot one, takes the bucketed path
        got = marks(mark_quota(log(spark, rows), 3, 60, bucket_windows, fan_in, light_rows))
        assert got == expected(rows, 3, 60)


def test_evenly_spaced_requests_never_merge_chains(spark):
    rows = [("a", s) for s in range(0, 3000, 7)]
    assert marks(mark_quota(log(spark, rows), 2, 60, 2, 3, 0)) == expected(rows, 2, 60)


def test_empty_log(spark):
    assert mark_quota(spark.createDataFrame([], DDL)).count() == 0


def test_a_hot_window_is_not_ranked_in_one_place(spark, monkeypatch):
    """A third of the rows in one window of one key; with and without a broadcast."""
    rng = np.random.default_rng(6)
    rows = [("hot", 500 + int(s)) for s in rng.integers(0, 59, 700)] + [(f"k{rng.integers(0, 3)}", int(s)) for s in rng.integers(0, 3000, 900)]
    want = expected(rows, 7, 60)
    assert marks(mark_quota(log(spark, rows), 7, 60, light_rows=50)) == want
    monkeypatch.setattr(quota, "fits_broadcast", lambda df: False)
    assert marks(mark_quota(log(spark, rows), 7, 60, light_rows=50)) == want


def streamed(spark, folder, events, batches, limit, window, lateness):
    """Marks of the events, dealt into files by ``batches`` (event ids per file), and of a heartbeat at the end."""
    for ids in batches:
        events.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    beat = spark.createDataFrame([(-1, None, START + timedelta(days=9))], DDL)
    beat.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        run = (
            mark_quota_stream(stream, limit, window, lateness)
            .writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/cp")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "open").load(f"{folder}/cp").count()
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.parquet(f"{folder}/out").filter("event_id >= 0"), state


def test_stream_in_any_order_within_the_lateness_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.integers(0, 5)}", int(s)) for s in rng.integers(0, 3000, 400)]
    delayed = sorted(range(400), key=lambda i: rows[i][1] + rng.integers(0, 300))
    out, open_windows = streamed(spark, str(tmp_path), log(spark, rows), [delayed[i : i + 100] for i in range(0, 400, 100)], 3, 60, "10 minutes")
    assert marks(out) == expected(rows, 3, 60)
    assert out.count() == 400
    batch = mark_quota(log(spark, rows), 3, 60).select("event_id", "retry_after")
    assert out.select("event_id", "retry_after").exceptAll(batch).isEmpty()
    assert open_windows == 0  # no key keeps state when its window is over


def test_requests_beyond_the_lateness_get_no_row(spark, tmp_path):
    rows = [("a", 1000 + s) for s in range(20)] + [("a", 5000)] + [("a", 0)]
    out, _ = streamed(spark, str(tmp_path), log(spark, rows), [list(range(20)), [20], [21]], 3, 60, "1 minute")
    assert marks(out) == expected(rows[:21], 3, 60)


def test_state_follows_slots_not_keys(spark, tmp_path):
    """Large whole keys and null; the store holds a row per slot, and windows left open by one batch go on in the next."""
    rng = np.random.default_rng(12)
    ddl = "event_id bigint, key bigint, ts timestamp"
    rows = [(i, None if i % 20 == 0 else 2**60 + i % 70, START + timedelta(seconds=int(s))) for i, s in enumerate(np.sort(rng.integers(0, 400, 600)))]
    events = spark.createDataFrame(rows, ddl)
    beats = spark.createDataFrame([(-1, 5, START + timedelta(seconds=500))], ddl)
    for part in (events.filter("event_id < 300"), events.filter("event_id >= 300"), beats):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        marked = mark_quota_stream(stream, 2, 300, "50 seconds", slots=2)
        writer = marked.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        writer.trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/cp").count()
    finally:
        spark.conf.set(STATE_STORE, before)
    out = spark.read.parquet(f"{tmp_path}/out").filter("event_id >= 0").select("event_id", "key", "allowed", "retry_after")
    single = events.filter("key is not null")
    assert out.filter("key is not null").exceptAll(mark_quota(single, 2, 300).select(out.columns)).isEmpty()
    nulls = mark_quota(events.filter("key is null").withColumn("key", F.lit(0).cast("bigint")), 2, 300)
    assert marks(out.filter("key is null")) == marks(nulls)
    assert out.count() == 600
    assert 0 < held <= 3
