import datetime as dt
import random

from pyspark.sql import functions as F

from attestor.streaming import monitor, windows

FOLDER = "/root/testdata/sf0.001"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def run(frame, spark, name, mode, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_windows_give_the_same_on_a_stream(spark, tmp_path):
    batch = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, make in {
        "tumbling": lambda e: windows.tumbling(e, "1 hour", ["event_type"], n=F.count("*")),
        "sliding": lambda e: windows.sliding(e, "1 hour", "30 minutes", ["event_type"], n=F.count("*")),
        "latest": lambda e: monitor.latest(e, ["user_id"], ["event_type"], ["ts", "event_id"]),
    }.items():
        assert run(make(stream()), spark, name, "complete", tmp_path) == {tuple(r) for r in make(batch).collect()}
    sessions = lambda e: windows.sessions(e, "6 hours", ["user_id"], n=F.count("*"))
    assert run(sessions(stream()), spark, "sessions", "complete", tmp_path) == {tuple(r) for r in sessions(batch).collect()}
    once = run(windows.first_events(stream().withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"]), spark, "once", "append", tmp_path)
    assert len(once) == batch.select("event_id").distinct().count()


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((rng.choice("ab"), at(rng.randint(0, 600))) for _ in range(120))
    want, kept = set(), {"a": [], "b": []}
    for n, (k, t) in enumerate(sorted(rows, key=lambda r: (r[0], r[1]))):
        kept[k] = [x for x in kept[k] if (t - x).total_seconds() < 60]
        ok = len(kept[k]) < 3
        kept[k] += [t] if ok else []
        want.add((n, k, t, ok))
    counted = sorted((k, t, ok) for _, k, t, ok in want)
    batch = spark.createDataFrame(rows, "client string, ts timestamp")
    assert sorted((r.client, r.ts, r.accepted) for r in monitor.accepted(batch, "client", 3, 60).collect()) == counted
    batch.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, ts timestamp").json(str(tmp_path / "in"))
    query = monitor.accepted(stream, "client", 3, 60).writeStream.format("memory").queryName("rate").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.client, r.ts, r.accepted) for r in spark.table("rate").collect()) == counted


def test_circuit_breaker(spark):
    rows = [("h", at(s), o) for s, o in [(0, "fail"), (1, "ok"), (2, "fail"), (3, "fail"), (4, "fail"), (5, "ok"), (70, "ok"), (71, "fail")]] + [("g", at(0), "fail")]
    found = monitor.circuit_states(spark.createDataFrame(rows, "host string, ts timestamp, outcome string")).where("host = 'h'").orderBy("ts").collect()
    assert [r.allowed for r in found] == [True, True, True, True, True, False, True, True]


def test_log_durations_and_states(spark, tmp_path):
    rows = [("t", 1, at(0), "parse", "start", "running", "a", "1"), ("t", 2, at(5), "parse", "end", None, "a", None), ("t", 3, at(6), "parse", "start", None, "final", "F"), ("u", 1, at(0), "x", "start", "queued", "a", "2"), ("u", 2, at(9), "x", "start", "queued", None, None)]
    log = spark.createDataFrame(rows, monitor.EVENT_SCHEMA)
    from attestor.sources.sinks import append_events

    append_events(log, str(tmp_path / "log"))
    append_events(log.limit(0), str(tmp_path / "log"))
    read = monitor.read_log(spark, str(tmp_path / "log"))
    assert read.count() == 5
    steps = monitor.step_durations(read, ["task_id", "step"], F.col("phase") == "start", F.col("phase") == "end").where("task_id = 't'").orderBy("nth").collect()
    assert [(r.nth, r.seconds) for r in steps] == [(1, 5.0), (2, None)]
    assert {(r.task_id, r.section, r.payload) for r in monitor.live_snapshot(read).collect()} == {("t", "final", "F"), ("u", "a", "2")}
    states = monitor.task_states(read)
    assert {(r.task_id, r.status, r.retries) for r in states.collect()} == {("t", "running", 0), ("u", "queued", 1)}
    assert monitor.interrupted(states, F.lit(at(4000))).count() == 2
    stream = monitor.read_log(spark, str(tmp_path / "log"), stream=True)
    part = lambda p: stream.where(F.col("phase") == p).withWatermark("ts", "1 hour")
    joined = monitor.stream_durations(part("start"), part("end"), ["task_id", "step"])
    assert {r[4] for r in run(joined, spark, "pairs", "append", tmp_path)} == {5.0}
    islands = monitor.streaks(spark.createDataFrame([("k", i, v) for i, v in enumerate("aabbba")], "k string, i int, v string"), "k", "i", "v")
    assert sorted((r.first, r.v, r.length) for r in islands.collect()) == [(0, "a", 2), (2, "b", 3), (5, "a", 1)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from attestor.sources import commit
    from attestor.streaming import upsert

    path = str(tmp_path / "state")
    both = lambda old, new: new if old is None else old.unionByName(new)
    batch = lambda i: spark.createDataFrame([(i,)], "i int")
    assert upsert.state(spark, path) is None and upsert.apply(path, batch(0), 0, both) and upsert.apply(path, batch(1), 1, both)
    held = upsert.state(spark, path)
    assert not upsert.apply(path, batch(1), 1, both) and not upsert.apply(path, batch(0), 0, both) and upsert.apply(path, batch(2), 2, both)
    assert sorted(r.i for r in held.collect()) == [0, 1]  # a reader of the version before is not disturbed
    assert sorted(r.i for r in upsert.state(spark, path).collect()) == [0, 1, 2] and commit.current(spark, path)["batch"] == 2
    assert len([p for p in (tmp_path / "state").iterdir() if p.is_dir()]) == 2


def test_a_failed_batch_is_done_again(spark, tmp_path):
    from attestor.streaming import upsert

    path, tries = str(tmp_path / "state"), []

    def merge(old, new):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("lost")
        return new if old is None else old.unionByName(new)

    rows = spark.range(5)
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: upsert.upserts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), path, merge, str(tmp_path / "offsets")).trigger(availableNow=True).start()
    for _ in range(2):
        try:
            stream().awaitTermination()
        except Exception:
            assert upsert.state(spark, path) is None
    assert upsert.state(spark, path).count() == 5 and len(tries) == 2


def test_a_bundle_is_published_whole_or_not(spark, tmp_path):
    import pytest

    from attestor.sources import commit

    path = str(tmp_path / "bundle")
    assert commit.read_bundle(spark, path) == {}
    for i in range(3):
        commit.write_bundle({"a": spark.range(i + 1), "b": spark.range(i)}, path)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        commit.write_bundle({"a": spark.range(9), "b": broken}, path)
    assert {n: t.count() for n, t in commit.read_bundle(spark, path).items()} == {"a": 3, "b": 2}
    assert len([p for p in (tmp_path / "bundle").iterdir() if p.is_dir()]) == 2


def test_steps_with_late_rows_and_expiry(spark, tmp_path):
    from attestor.streaming import steps

    before = spark.conf.get(steps.STORE[0])
    spark.conf.set(*steps.STORE)
    schema = "k string, ts timestamp, kind string"
    batches = [
        [("a", at(0), "start"), ("b", at(5), "start"), ("a", at(20), "end")],
        [("a", at(10), "start"), ("c", at(30), "start"), ("c", at(200), "end"), ("x", at(500), "start")],  # the second start of a comes late but in time
        [("b", at(6), "end"), ("x", at(505), "end"), ("y", at(2000), "start")],  # the end of b is behind the watermark
        [("z", at(9000), "start")],
    ]
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            found = steps.durations(stream, ["k"], F.col("kind") == "start", F.col("kind") == "end", most="100 seconds", delay="60 seconds")
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(steps.STORE[0], before)
    got = {(r.k, r.nth, r.seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, None), ("a", 2, 10.0), ("b", 1, None), ("c", 1, None), ("x", 1, 5.0), ("y", 1, None)}
