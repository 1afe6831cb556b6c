"""Streams in several micro-batches against the batch operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.operators import history, phases
from gleaner.plans.history import KEY, events
from gleaner.session import scratch_path
from gleaner.streaming import jobs, state, windows


@pytest.fixture(scope="module")
def parts(spark, folder):
    """Events in four files in time order."""
    path = scratch_path(spark, "parts")
    df = events(spark, folder).filter("user_id % 5 = 0").withColumn("ts", F.col("ts").cast("timestamp"))
    days = F.dayofmonth("ts")
    for low in (1, 9, 17, 25):  # one write after the other: streams read files by age
        df.filter(days.between(low, low + 7)).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


def stream(spark, parts):
    return jobs.read_table(spark, parts, "events", files_per_trigger=1)


def in_order(spark, parts):
    return spark.read.parquet(f"{parts}/events.parquet")


def compare(a, b, columns):
    left, right = (sorted(tuple(r) for r in df.select(*columns).collect()) for df in (a, b))
    assert len(left) == len(right)
    for x, y in zip(left, right):
        assert x == pytest.approx(y, rel=1e-6, abs=1e-6)


def test_forgetting(spark, parts):
    rows = stream(spark, parts).select("user_id", "ts", "event_id", F.col("value").alias("loss"))
    live = jobs.run_available(state.process(rows, state.Forgetting()), "t-forgetting")
    compare(live, history.forgetting(in_order(spark, parts), *KEY, "value"), ["event_id", "forgetting"])


def test_sample_memory(spark, parts):
    def prepare(df):
        return df.select(
            "user_id", "ts", "event_id", F.col("value").alias("uncertainty"), F.col("value").alias("impact"),
            (F.col("event_type") == "purchase").alias("selected"),
        )

    live = jobs.run_available(state.process(prepare(stream(spark, parts)), state.SampleMemory()), "t-memory")
    batch = history.sample_memory(prepare(in_order(spark, parts)), *KEY)
    compare(live, batch, ["event_id", "step", "volatility", "staleness"])


def test_phase_detector(spark, parts):
    def prepare(df):
        return df.select(
            "user_id", "ts", "event_id", (F.col("value") / 50).alias("norm"), F.cos(F.col("k") / 25).alias("alignment"),
            (F.col("value") / 100).alias("loss"), F.log(F.col("k") + 1).alias("entropy"),
        )

    live = jobs.run_available(state.process(prepare(stream(spark, parts)), state.PhaseDetector()), "t-phases")
    batch = phases.detect_phases(prepare(in_order(spark, parts)), *KEY)
    compare(live, batch, ["event_id", "score", "is_transition", "confidence"])


def test_late_rows_are_dropped(spark):
    path = scratch_path(spark, "late")
    schema = "tag string, value double, ts timestamp"
    days = ["2024-01-01 01:00:00", "2024-01-09 01:00:00", "2024-01-01 02:00:00", "2024-01-01 03:00:00", "2024-01-20 01:00:00"]
    for i, day in enumerate(days):
        spark.createDataFrame([("a", 1.0, day)], "tag string, value double, ts string").withColumn(
            "ts", F.col("ts").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet/part={i}")
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events.parquet")
    got = jobs.run_available(windows.tumbling(frames, "tag", "value"), "t-late")
    counts = {str(r["start"])[:10]: r["n"] for r in got.collect()}
    assert counts["2024-01-09"] == 1
    # lateness is judged by the watermark one trigger back: the third file still counts, the fourth does not
    assert counts["2024-01-01"] == 2
    assert "2024-01-20" not in counts


def test_rows_out_of_order_give_the_batch_result(spark):
    """Two samples over three files; rows come up to a day behind others. The last file only moves the watermark."""
    path = scratch_path(spark, "disorder")
    schema = "user_id long, ts timestamp, event_id long, uncertainty double, selected boolean"
    hours = [(u, h, (h * 7 + u) % 5 / 2.0, h % 4 == u) for u in (1, 2) for h in (0, 1, 2, 3, 20, 21, 22, 40, 41, 90, 91, 95)]
    rows = [(u, f"2024-03-{1 + h // 24:02d} {h % 24:02d}:00:00", 1000 * u + h, x, c) for u, h, x, c in hours]
    file_of = lambda h: 0 if h in (1, 3, 20, 21, 0, 22) and h != 3 else 1  # hour 3 comes with the second file
    parts = [[r for r, (_, h, _, _) in zip(rows, hours, strict=True) if file_of(h) == k] for k in (0, 1)]
    parts.append([(9, "2024-04-01 00:00:00", 1, 0.0, False)])
    for k, part in enumerate(parts):
        text = spark.createDataFrame(part[::-1], "user_id long, ts string, event_id long, uncertainty double, selected boolean")
        text.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet/part={k}")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events.parquet")
    memory = state.OrderedSampleMemory(ttl_ms=24 * 3600 * 1000)
    found = jobs.run_available(state.process_in_order(live, memory, "1 day"), "t-ordered").collect()
    expected = {}
    for u in (1, 2):
        past, chosen, step, seen = [], -1, 0, None
        for _, h, x, c in sorted(r for r in hours if r[0] == u):
            if seen is not None and h - seen > 24:
                past, chosen, step = [], -1, 0
            past = [*past, x][-10:]
            mean = sum(past) / len(past)
            expected[1000 * u + h] = (step, sum((v - mean) ** 2 for v in past) / len(past), step - chosen if chosen >= 0 else step)
            chosen, step, seen = (step if c else chosen), step + 1, h
    got = {r["event_id"]: (r["step"], r["volatility"], r["staleness"]) for r in found if r["user_id"] < 9}
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(expected[k])


def test_a_replayed_batch_of_a_stream_counts_once(spark, parts):
    """The same micro-batches again, as after a restart that lost the sink's answer."""
    from gleaner.sources import runlog

    path = scratch_path(spark, "replay")
    rows = lambda: stream(spark, parts).select(
        F.lit("r").alias("run"), F.lit("epoch").alias("kind"), F.col("event_id").alias("epoch"), "ts", F.col("value").alias("payload")
    )
    for attempt in range(2):
        query = rows().writeStream.foreachBatch(lambda batch, number: runlog.append_log(batch, f"{path}/log", number))
        query.option("checkpointLocation", f"{path}/checkpoint{attempt}").trigger(availableNow=True).start().awaitTermination()
    assert runlog.read_log(spark, f"{path}/log").count() == in_order(spark, parts).count()


def test_the_state_store_of_the_session_comes_back(spark, parts):
    before = spark.conf.get(jobs.STORE, None)
    rows = stream(spark, parts).select("user_id", "ts", "event_id", F.col("value").alias("loss"))
    jobs.run_available(state.process(rows, state.Forgetting()), "t-store")
    assert spark.conf.get(jobs.STORE, None) == before


def test_samples_share_state_and_keep_their_results(spark):
    """500 samples in eight packs over four files: lives that go on, end and start anew, and rows without a sample, an id or a value."""
    import numpy as np

    path, rng = scratch_path(spark, "packs"), np.random.default_rng(3)
    hours = np.sort(rng.uniform(0, 400, 4000))
    rows = [
        (int(u) if u else None, float(h), n if n % 97 else None, None if n % 31 == 0 else float(x), bool(c))
        for n, (u, h, x, c) in enumerate(zip(rng.integers(0, 501, 4000), hours, rng.random(4000), rng.random(4000) < 0.2, strict=True))
    ]
    rows = [(u and u + 2**60, round(h * 3600) * 1_000_000 + n, e, x, c) for n, (u, h, e, x, c) in enumerate(rows)]
    for k in range(4):  # the last file only moves the watermark
        part = rows[k * 1334 : (k + 1) * 1334] if k < 3 else [(9, 4000 * 3_600_000_000, 1, 0.0, False)]
        text = spark.createDataFrame(part[::-1], "user_id long, at long, event_id long, uncertainty double, selected boolean")
        text.withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet/part={k}")
    schema = "user_id long, ts timestamp, event_id long, uncertainty double, selected boolean"
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events.parquet")
    memory = state.OrderedSampleMemory(ttl_ms=100 * 3600 * 1000)
    found = state.process_in_order(live, memory, "1 day", packs=8)
    got = [r for r in jobs.run_available(found, "t-packs").collect() if r["user_id"] != 9]
    expected, lives = [], {}
    for u, at, e, x, c in rows:
        past, chosen, step, seen = lives.get(u, ([], -1, 0, at))
        if at - seen > 100 * 3_600_000_000:
            past, chosen, step = [], -1, 0
        past = [*past, np.nan if x is None else x][-10:]
        known = [v for v in past if v == v]
        spread = 0.0 if step == 0 else float(np.var(known)) if known else None
        expected.append((u, e, step, spread, step - chosen if chosen >= 0 else step))
        lives[u] = (past, step if c else chosen, step + 1, at)
    place = lambda r: (r[0] or -1, r[2], r[4], r[1] or -1)
    assert len(got) == len(expected)
    for r, e in zip(sorted(map(tuple, got), key=place), sorted(expected, key=place), strict=True):
        assert r[:3] == e[:3] and r[4] == e[4]
        assert r[3] == pytest.approx(e[3])


def test_state_of_samples_in_order_grows_with_packs_not_samples(spark):
    path = scratch_path(spark, "many")
    rows = spark.range(1000).select(
        (F.col("id") % 200).alias("user_id"), F.timestamp_seconds(10**9 + F.col("id") * 60).alias("ts"), F.col("id").alias("event_id"),
        F.rand(1).alias("uncertainty"), (F.col("id") % 3 == 0).alias("selected"),
    )
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    memory = state.OrderedSampleMemory(ttl_ms=24 * 3600 * 1000)
    found = state.process_in_order(jobs.read_table(spark, path, "events"), memory, "1 hour", packs=4)
    before = spark.conf.get(jobs.STORE, None)
    spark.conf.set(jobs.STORE, jobs.STATE_STORE)
    try:
        query = found.writeStream.format("memory").queryName("t_many").option("checkpointLocation", scratch_path(spark, "t-many"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(jobs.STORE) if before is None else spark.conf.set(jobs.STORE, before)
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) < 50
    assert spark.table("t_many").count() == 940  # the watermark stands an hour behind the newest row


def test_a_row_at_the_watermark_is_passed(spark):
    """A microsecond behind it a row waits for the next watermark."""
    path = scratch_path(spark, "edge")
    rows = [(u, 10**15 + m * 60_000_000 + extra, u, 1.0, False) for u, m, extra in [(1, 0, 0), (2, 60, 0), (3, 60, 1), (4, 120, 0), (5, 300, 0)]]
    for part, passed in ((rows[:4], [1, 2]), (rows[4:], [1, 2, 3, 4])):
        table = spark.createDataFrame(part, "user_id long, at long, event_id long, uncertainty double, selected boolean")
        table.withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
        memory = state.OrderedSampleMemory(ttl_ms=24 * 3600 * 1000)
        found = state.process_in_order(stream(spark, path), memory, "1 hour")
        assert sorted(r["user_id"] for r in jobs.run_available(found, "t-edge").collect()) == passed
