"""Request quotas in batch and as a stream."""

from pyspark.sql import functions as F

from quirework.functions.common import materialize, scratch_path
from quirework.operators.quota import mark_quota
from quirework.plans import fixtures as X
from quirework.plans.catalog import query
from quirework.streaming.quota_stream import ROCKS_DB, STATE_STORE, mark_quota_stream

_LIMIT, _DAY = 3, 86_400

# windows of a user follow one another: each opens at the first event after the former one's end
_QUOTA = f"""WITH RECURSIVE {{before}}windows AS (
  SELECT user_id, min(ts) AS opened FROM {{log}} GROUP BY 1
  UNION ALL
  SELECT user_id, (SELECT min(e.ts) FROM {{log}} e WHERE e.user_id = w.user_id AND e.ts >= w.opened + INTERVAL {_DAY} SECOND)
  FROM windows w WHERE opened IS NOT NULL),
placed AS (
  SELECT e.user_id, e.event_id, e.ts, w.opened FROM {{log}} e
  ASOF JOIN (SELECT * FROM windows WHERE opened IS NOT NULL) w ON w.user_id = e.user_id AND e.ts >= w.opened)
SELECT event_id, user_id AS "key", allowed, CASE WHEN NOT allowed THEN
         ({_DAY} * CAST(1000000 AS BIGINT) - (epoch_us(ts) - epoch_us(opened))) / 1000000 END AS retry_after
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, opened ORDER BY ts, event_id) <= {_LIMIT} AS allowed FROM placed)"""


def requests(spark, sf_dir):
    return X.load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")
    )


_PLAIN = _QUOTA.format(before="", log="events")
# a third of the requests are one user's, all inside one window
_HEAVY = _QUOTA.format(
    before="""requests AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id,
         CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' + to_seconds(event_id % 80000) ELSE ts END AS ts
  FROM events), """,
    log="requests",
)


@query("quota_batch", _PLAIN)
def quota_batch(spark, sf_dir):
    return mark_quota(requests(spark, sf_dir), _LIMIT, _DAY).drop("ts")


@query("quota_heavy", _HEAVY)
def quota_heavy(spark, sf_dir):
    """The path of keys with many requests, a hot window among them."""
    hot = F.col("event_id") % 3 == 0
    squeezed = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00")) + F.col("event_id") % 80000)
    log = requests(spark, sf_dir).select(
        "event_id", F.when(hot, F.lit(-1)).otherwise(F.col("key")).alias("key"), F.when(hot, squeezed).otherwise(F.col("ts")).alias("ts")
    )
    return mark_quota(log, _LIMIT, _DAY, light_rows=20).drop("ts")


_ROUNDS = 4
_FILE_ROWS = 1_000_000


@query("quota_stream", _PLAIN)
def quota_stream(spark, sf_dir):
    """Requests arriving in four rounds, up to a day out of order, then a heartbeat that moves the watermark past them all.

    A round is so many files, each written by a task of its own, and a batch takes as many: it holds one round.
    """
    log = requests(spark, sf_dir)
    second = F.unix_timestamp("ts")
    span = log.agg(F.min(second).alias("low"), F.max(second).alias("high")).first()
    shifted = second + F.pmod(F.xxhash64("event_id"), F.lit(_DAY)) - F.lit(span["low"])
    arrival = F.floor(shifted * _ROUNDS / F.lit(span["high"] - span["low"] + _DAY + 1))
    out = scratch_path(spark, "quota")
    dealt = materialize(log.withColumn("arrival", arrival), "requests")
    rows = {r["arrival"]: r["count"] for r in dealt.groupBy("arrival").count().collect()}
    files = max(1, min(rows.get(number, 0) for number in range(_ROUNDS)) // _FILE_ROWS)
    for number in range(_ROUNDS):
        one_round = dealt.filter(F.col("arrival") == number).drop("arrival")
        laid = one_round.repartition(files) if files > 1 else one_round.coalesce(1)
        laid.write.mode("append").parquet(f"{out}/arrivals")
    heartbeat = F.timestamp_seconds(F.lit(span["high"] + 4 * _DAY)).alias("ts")
    key = F.lit(None).cast(dict(log.dtypes)["key"]).alias("key")
    spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), key, heartbeat).write.mode("append").parquet(f"{out}/arrivals")
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/arrivals")
    marked = mark_quota_stream(arriving, _LIMIT, _DAY, lateness="2 days")
    provider = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        run = (
            marked.writeStream.format("parquet")
            .option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, provider)
    return spark.read.schema(marked.schema).parquet(f"{out}/rows").filter("event_id >= 0").drop("ts")
