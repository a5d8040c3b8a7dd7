"""Durations of steps on one stream: each key keeps its open step and the events that the watermark has not passed, with timers in event time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Events of a key that are kept as one value of its state.
CHUNK = 1000


class _Steps(StatefulProcessor):
    """Waits until the watermark has passed an event, so events count in the order of time however they arrive.

    An event is kept as one number that orders by time, starts before ends. A key has a timer for the earliest event of a batch, not one for each: when it is due, all that
    the watermark has passed is worked off, and the next timer is for the earliest of what is left.
    """

    def __init__(self, most: int, width: int) -> None:
        self.most, self.given = most, Row(*(f"k{i}" for i in range(width)), "nth", "started", "ended")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events array<long>")
        self.open = handle.getValueState("open", "at long, nth long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        events = [2 * row["at"] + (not row["start"]) for row in rows]
        if events:
            self._keep(events)
            self.handle.registerTimer(-(-(min(events) >> 1) // 1000))
        return iter(())

    def _keep(self, events: list[int]) -> None:
        self.waiting.appendList([(events[i : i + CHUNK],) for i in range(0, len(events), CHUNK)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(e for chunk in self.waiting.get() for e in chunk[0])
        cut = bisect_right(events, 2 * passed + 1)
        due, later = events[:cut], events[cut:]
        if due:
            self.waiting.clear()
            if later:
                self._keep(later)
        at, nth, ended = before = self.open.get() or (None, 0, True)
        out = []
        for event in due:
            when, start = event >> 1, not event & 1
            if not ended and when - at > self.most:
                out.append((nth, at, None))
                ended = True
            if start:
                if not ended:
                    out.append((nth, at, None))
                at, nth, ended = when, nth + 1, False
            elif not ended:
                out.append((nth, at, when))
                ended = True
        if not ended and passed - at > self.most:  # no end can come in time any more
            out.append((nth, at, None))
            ended = True
        if (at, nth, ended) != tuple(before):
            self.open.update((at, nth, ended))
        left = [e >> 1 for e in later[:1]] + ([] if ended else [at + self.most + 1])
        if left:
            self.handle.registerTimer(-(-min(left) // 1000))
        return iter([self.given(*key, *row) for row in out])

    def close(self) -> None:
        pass


def durations(events: DataFrame, keys: list[str], start: Column, end: Column, most: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(keys, nth, started, ended, seconds) on a stream of events with ``ts``: each start with the first end after it, before the next start and within ``most``.

    A row comes when the watermark (``delay`` behind the latest event) shows that it is final; a start without an end has null in the place of it. Events later than the
    watermark are dropped. Needs the session's ``STORE`` setting. State of a key is its open step and the events that still wait.
    """
    spark = events.sparkSession
    span = spark.range(1).select((F.unix_micros(F.lit("2000-01-01").cast("timestamp") + F.expr(f"INTERVAL {most}")) - F.unix_micros(F.lit("2000-01-01").cast("timestamp"))).alias("us")).first().us
    marked = events.where(start | end).select(*keys, F.col("ts").cast("timestamp").alias("ts"), start.alias("start")).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    kinds = dict(events.dtypes)
    shape = ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(keys)), "nth long, started long, ended long"])
    found = marked.groupBy(*keys).transformWithState(statefulProcessor=_Steps(span, len(keys)), outputStructType=shape, outputMode="Append", timeMode="EventTime")
    named = found.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "nth", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), ((F.col("ended") - F.col("started")) / 1e6).alias("seconds"))
    return named
