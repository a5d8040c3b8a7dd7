"""The event log of tasks: reading it, durations of steps, latest states, streaks, requests within a rate.

Events have ``task_id, seq, ts, step, phase (start or end), status, section, payload``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "task_id string, seq long, ts timestamp, step string, phase string, status string, section string, payload string"
RATE, RATE_SECONDS = 60, 60
FAILURES, COOLDOWN_SECONDS = 3, 60.0
FINAL_SECTION = "final"


def read_log(spark: SparkSession, path: str, stream: bool = False, files: int = 100) -> DataFrame:
    """A log of JSON lines, as a batch or as a stream of new files."""
    if stream:
        return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files).json(path)
    return spark.read.schema(EVENT_SCHEMA).json(path)


def step_durations(events: DataFrame, keys: list[str], start: Column, end: Column, order: str = "ts") -> DataFrame:
    """(keys, nth, started, ended, seconds): each start of a key with the first end after it, before the next start.

    A start without an end has null in the place of it. The pairing is a window over the key in order of time.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = events.where(start | end).withColumns({"nth": run, "_start": start}).where("nth > 0")
    paired = marked.groupBy(*keys, "nth").agg(F.min(F.when(F.col("_start"), F.col(order))).alias("started"), F.min(F.when(~F.col("_start"), F.col(order))).alias("ended"))
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return paired.withColumn("seconds", seconds)


def stream_durations(starts: DataFrame, ends: DataFrame, keys: list[str], most: str = "1 hour") -> DataFrame:
    """The same on streams: starts and ends with watermarks on ``ts``, joined when an end follows within ``most``."""
    s = starts.select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("ts").alias("started"))
    e = ends.select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col("ts").alias("ended"))
    on = (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {most}"))
    for k in keys:
        on = on & (F.col(f"s_{k}") == F.col(f"e_{k}"))
    seconds = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    return s.join(e, on).select(*(F.col(f"s_{k}").alias(k) for k in keys), "started", "ended", seconds.alias("seconds"))


def latest(events: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """For each key the last value of each column that is not null; works on streams in update mode, too."""
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return events.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values))


def live_snapshot(events: DataFrame) -> DataFrame:
    """(task_id, section, payload): the last payload of each section; a final payload stands for its whole task."""
    last = latest(events.where("section is not null"), ["task_id", "section"], ["payload"], ["ts", "seq"])
    final = last.where(F.col("section") == FINAL_SECTION).select("task_id", F.lit(True).alias("_final"))
    met = last.join(final, "task_id", "left")
    return met.where(F.col("_final").isNull() | (F.col("section") == FINAL_SECTION)).drop("_final")


def task_states(events: DataFrame) -> DataFrame:
    """(task_id, status, updated_at, retries): the last status of each task, and how often it was queued again."""
    known = events.where("status is not null")
    queued = F.count_if(F.col("status") == "queued")
    return known.groupBy("task_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("updated_at"), F.greatest(F.lit(0), queued - 1).alias("retries"))


def interrupted(states: DataFrame, now: Column, quiet: str = "1 hour") -> DataFrame:
    """Running or queued tasks that have been quiet for too long, as ``partial``."""
    return states.where(F.col("status").isin("running", "queued") & (F.col("updated_at") < now - F.expr(f"INTERVAL {quiet}"))).withColumn("status", F.lit("partial"))


def streaks(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, first, last, length): runs of one value in the order of a key."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    marked = rows.select(key, order, value, F.when(first, 1).otherwise(changed).alias("_c"))
    marked = marked.withColumn("_i", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_i").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_i")


def request_rates(requests: DataFrame, key: str, ts: str = "ts", seconds: int = RATE_SECONDS) -> DataFrame:
    """Requests with ``in_window``: how many the client has made in the last ``seconds``, this one included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.withColumn("in_window", F.count("*").over(w))


def accepted(requests: DataFrame, key: str, most: int = RATE, seconds: int = RATE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, ts, accepted) for a stream or batch of (key, ts): at most ``most`` accepted requests within ``seconds``.

    Only accepted requests count, so the decision needs those before it: the state of a client is the times of at most
    ``most`` requests, and expires in event time when the client is quiet. On a stream, requests come ``late`` at most.
    """

    def decide(key_value: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for at in rows["ts"]:
            now = at.value // 1000
            kept = [t for t in kept if now - t < seconds * 1_000_000]
            ok = len(kept) < most
            kept += [now] if ok else []
            out.append((key_value[0], at, ok))
        state.update((kept,))
        state.setTimeoutTimestamp(max(rows["ts"].max().value // 1_000_000 + 2 * seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "ts", "accepted"])

    kind = dict(requests.dtypes)[key]
    asked = requests.select(key, F.col("ts").cast("timestamp").alias("ts"))
    schema = f"{key} {kind}, ts timestamp, accepted boolean"
    if asked.isStreaming:
        timed = asked.withWatermark("ts", late)
        return timed.groupBy(key).applyInPandasWithState(decide, schema, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return asked.repartition(key).sortWithinPartitions(key, "ts").mapInPandas(_replay_rate(key, most, seconds), schema)


def _replay_rate(key: str, most: int, seconds: int):
    """The same over sorted rows, a batch at a time: memory holds one client's window, not all of a client's requests."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, kept = None, []
        for batch in batches:
            out = []
            for k, at in zip(batch[key], batch["ts"], strict=True):
                if k != now_key:
                    now_key, kept = k, []
                now = at.value // 1000
                kept = [t for t in kept if now - t < seconds * 1_000_000]
                ok = len(kept) < most
                kept += [now] if ok else []
                out.append(ok)
            yield batch.assign(accepted=out)

    return work


def circuit_states(events: DataFrame, failures: int = FAILURES, cooldown: float = COOLDOWN_SECONDS) -> DataFrame:
    """(host, ts, outcome, allowed) of a request log (host, ts, outcome ``ok`` or ``fail``): what a circuit breaker would do.

    After ``failures`` failures in a row a host is spared for ``cooldown`` seconds; requests in that time are not allowed and
    change nothing. Rows of a host come sorted, a batch at a time; the state is a few numbers.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, failed, opened = None, 0, None
        for batch in batches:
            out = []
            for h, at, outcome in zip(batch["host"], batch["ts"], batch["outcome"], strict=True):
                if h != host:
                    host, failed, opened = h, 0, None
                ok = opened is None or (at - opened).total_seconds() >= cooldown
                if ok:
                    if opened is not None:
                        failed, opened = 0, None
                    failed = failed + 1 if outcome == "fail" else 0
                    opened = at if failed >= failures else None
                out.append(ok)
            yield batch.assign(allowed=out)

    kind = dict(events.dtypes)["host"]
    rows = events.select("host", F.col("ts").cast("timestamp").alias("ts"), "outcome").repartition("host").sortWithinPartitions("host", "ts")
    return rows.mapInPandas(work, f"host {kind}, ts timestamp, outcome string, allowed boolean")


def completed_calls(calls: DataFrame) -> DataFrame:
    """One row a call key: the first completed result; later calls of the key would be answered by it."""
    done = calls.where("status = 'completed'")
    return done.groupBy("key").agg(F.min_by("result", F.struct("ts", "result")).alias("result"), F.count("*").alias("calls"))
