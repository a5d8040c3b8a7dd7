"""Event logs: durations, states, streaks, rates, windows. Streams run the same functions; tests compare both."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.clustering import shared_base
from attestor.queries.base import query, table
from attestor.streaming import monitor, steps, windows


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


_STEPS = """
WITH m AS (SELECT user_id, ts, event_type, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM events WHERE event_type IN ('view', 'purchase'))
SELECT user_id, CAST(nth AS BIGINT) AS nth, min(ts) FILTER (event_type = 'view') AS started, min(ts) FILTER (event_type = 'purchase') AS ended,
  (epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view'))) / 1000000.0 AS seconds FROM m WHERE nth > 0 GROUP BY 1, 2
"""


@query(_STEPS)
def step_durations(spark: SparkSession, d: str) -> DataFrame:
    """From each start (view) of a user to the first end (purchase) before the next start."""
    return monitor.step_durations(_events(spark, d), ["user_id"], F.col("event_type") == "view", F.col("event_type") == "purchase")


@query(_STEPS)
def steps_on_a_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same on a stream that brings every other event first, with the open steps as keyed state and timers that say when a step is final."""
    events = _events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    folder = f"{shared_base(spark).rstrip('/')}/attestor-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    # the last event is far ahead, so that all others are passed
    end = events.agg((F.max("ts") + F.expr("INTERVAL 30000 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit("view").alias("event_type"))
    before = spark.conf.get(steps.STORE[0])
    spark.conf.set(*steps.STORE)
    try:
        for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0 or event_id is null"), end):
            part.write.mode("append").parquet(f"{folder}/in")
            arriving = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
            found = steps.durations(arriving, ["user_id"], F.col("event_type") == "view", F.col("event_type") == "purchase", most="10000 days", delay="10000 days")
            found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(steps.STORE[0], before)
    kind = _events(spark, d).schema["ts"].dataType
    return spark.read.parquet(f"{folder}/out").withColumns({c: F.col(c).cast(kind) for c in ("started", "ended")})


@query("""
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM c)
SELECT user_id, any_value(event_type) AS event_type, min(ts) AS first, max(ts) AS last, count(*) AS length FROM i GROUP BY user_id, isl
""")
def no_progress_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one event type of a user."""
    return monitor.streaks(_events(spark, d), "user_id", "ts", "event_type")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events
""")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """How many requests a client has made within an hour, at each request."""
    return monitor.request_rates(_events(spark, d), "user_id", "ts", 3600).select("event_id", "in_window")


@query()
def rate_limit_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Which requests a limit of three a day accepts. Only accepted ones count, which needs state; a test replays it."""
    return monitor.accepted(_events(spark, d), "user_id", 3, 86400).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query()
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Which requests a breaker lets through: users are hosts, errors are failures. Needs state; a test replays it."""
    rows = _events(spark, d).select(F.col("user_id").alias("host"), "ts", F.when(F.col("event_type") == "error", "fail").otherwise("ok").alias("outcome"))
    return monitor.circuit_states(rows, 2, 86400.0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1
""")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each user."""
    return monitor.latest(_events(spark, d), ["user_id"], ["event_type", "value"], ["ts", "event_id"])


@query("""
WITH l AS (SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY 1, 2), f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id AS task_id, CASE WHEN event_type = 'purchase' THEN 'final' ELSE event_type END AS section, payload FROM l WHERE event_type = 'purchase' OR user_id NOT IN (SELECT user_id FROM f)
""")
def live_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The last payload of each section (event type) of a task (user); a final one (purchase) stands for all."""
    rows = _events(spark, d).select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "purchase", "final").otherwise(F.col("event_type")).alias("section"), F.col("props").alias("payload"), "ts", F.col("event_id").alias("seq"))
    return monitor.live_snapshot(rows)


@query("""
SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, greatest(0, count(*) FILTER (event_type = 'queued') - 1) AS retries FROM (SELECT * REPLACE (CASE WHEN event_type = 'signup' THEN 'queued' ELSE event_type END AS event_type) FROM events) GROUP BY 1
""")
def task_states(spark: SparkSession, d: str) -> DataFrame:
    """The last status of each task (user), and how often it was queued (signed up) again."""
    rows = _events(spark, d).select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "signup", "queued").otherwise(F.col("event_type")).alias("status"), "ts", F.col("event_id").alias("seq"))
    return monitor.task_states(rows)


@query("SELECT user_id || ':' || event_type AS key, arg_min(props, (ts, props)) AS result, count(*) AS calls FROM events WHERE event_type <> 'error' GROUP BY 1")
def idempotent_calls(spark: SparkSession, d: str) -> DataFrame:
    """The first completed result of each call key."""
    rows = _events(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("props").alias("result"), "ts", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    return monitor.completed_calls(rows)


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    return windows.tumbling(_events(spark, d), "1 hour", ["event_type"], n=F.count("*"))


@query("""
WITH w AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS window_start FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM w GROUP BY ALL
""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour, a window each half hour."""
    return windows.sliding(_events(spark, d), "1 hour", "30 minutes", ["event_type"], n=F.count("*"))


@query("""
WITH c AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS ch FROM events), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM c)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOURS AS window_end, user_id, count(*) AS n FROM i GROUP BY user_id, s
""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events with less than six hours between them."""
    return windows.sessions(_events(spark, d), "6 hours", ["user_id"], n=F.count("*"))


@query("SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1, 2")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type."""
    return windows.first_events(_events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", "ts", "event_id")
