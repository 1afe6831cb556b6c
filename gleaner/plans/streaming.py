"""Streaming queries over `events`; each processes the files that are there and ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.plans.base import query
from gleaner.plans.history import EV, MEMORY, PHASES, W, last
from gleaner.session import scratch_path
from gleaner.sources import runlog
from gleaner.sources.tables import table
from gleaner.streaming import jobs, state, windows


def _stream(spark, folder):
    df = jobs.read_table(spark, folder, "events")
    return df.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int")).withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def _flat(df):
    kept = df.select(
        F.col("event_type").alias("tag"), F.col("start").cast("timestamp_ntz").alias("start"),
        F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("mean", 6).alias("mean"), "low", "high",
    )
    return kept


# The last watermark ends two days before the newest event; later windows stay open.
CLOSED = "(SELECT max(ts) - INTERVAL 2 DAY FROM events)"
AGG = "count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high"


@query(
    "stream_metrics_windows",
    f"""SELECT event_type AS tag, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", {AGG}
    FROM events GROUP BY event_type, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED}""",
)
def stream_metrics_windows(spark, folder):
    return _flat(jobs.run_available(windows.tumbling(_stream(spark, folder), "event_type", "value"), "tumbling"))


@query(
    "stream_metrics_sliding",
    f"""WITH e AS (SELECT *, date_trunc('day', ts) - d * INTERVAL 1 DAY AS start FROM events, (SELECT unnest([0, 1]) AS d))
    SELECT event_type AS tag, start, start + INTERVAL 2 DAY AS "end", {AGG} FROM e
    GROUP BY event_type, start HAVING start + INTERVAL 2 DAY <= {CLOSED}""",
)
def stream_metrics_sliding(spark, folder):
    return _flat(jobs.run_available(windows.sliding(_stream(spark, folder), "event_type", "value"), "sliding"))


@query(
    "stream_metrics_sessions",
    f"""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true)::INT AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", {AGG} FROM s GROUP BY user_id, session
    HAVING max(ts) + INTERVAL 12 HOUR <= {CLOSED}""",
)
def stream_metrics_sessions(spark, folder):
    found = jobs.run_available(windows.sessions(_stream(spark, folder), "user_id", "value"), "sessions")
    return found.select(
        "user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"),
        "n", F.round("mean", 6).alias("mean"), "low", "high",
    )


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, folder):
    """First event per user and type within a delay of two days, which is how long a key stays in the state.

    The table is one trigger here, and inside a trigger every repeat is dropped,
    so the batch form is DISTINCT; over several triggers a key that is quiet for
    longer than the delay comes again.
    """
    kept = windows.drop_repeats(_stream(spark, folder), ["user_id", "event_type"], late="2 days")
    return jobs.run_available(kept.select("user_id", "event_type"), "dedup")


@query(
    "stream_forgetting",
    f"""WITH {EV}, r AS (SELECT *, coalesce((value > lag(value) OVER {W()})::INT, 0) AS rose FROM ev)
    SELECT user_id, event_id, round(CASE WHEN rn > 1 THEN (sum(rose) OVER {last(9)})::DOUBLE / (least(rn, 10) - 1)
      ELSE 0 END, 6) AS forgetting FROM r""",
)
def stream_forgetting(spark, folder):
    rows = _stream(spark, folder).select("user_id", "ts", "event_id", F.col("value").alias("loss"))
    found = jobs.run_available(state.process(rows, state.Forgetting()), "forgetting")
    return found.withColumn("forgetting", F.round("forgetting", 6))


@query(
    "stream_sample_memory",
    f"WITH {EV}, {MEMORY} SELECT user_id, event_id, step, round(volatility, 6) AS volatility, staleness FROM mem",
)
def stream_sample_memory(spark, folder):
    rows = _stream(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("value") / 7).alias("uncertainty"),
        (F.col("event_type") == "purchase").alias("selected"),
    )
    found = jobs.run_available(state.process(rows, state.SampleMemory()), "memory")
    return found.withColumn("volatility", F.round("volatility", 6))


@query(
    "stream_memory_in_order",
    f"""WITH {EV}, gaps AS (SELECT *, coalesce(ts - lag(ts) OVER {W()} > INTERVAL 12 HOUR, true)::INT AS fresh FROM ev),
    lives AS (SELECT *, sum(fresh) OVER {W()} AS life FROM gaps),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, life ORDER BY rn) - 1 AS step FROM lives)
    SELECT user_id, event_id, step, round(CASE WHEN step > 0 THEN var_pop(value / 7) OVER v ELSE 0 END, 6) AS volatility,
      step - coalesce(max(CASE WHEN event_type = 'purchase' THEN step END) OVER before, 0) AS staleness
    FROM n
    WINDOW v AS (PARTITION BY user_id, life ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
      before AS (PARTITION BY user_id, life ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    QUALIFY ts <= {CLOSED}""",
)
def stream_memory_in_order(spark, folder):
    """The memory of samples in event time: rows wait for the watermark, two days behind the newest event; a sample that was
    quiet for half a day starts anew."""
    rows = _stream(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("value") / 7).alias("uncertainty"), (F.col("event_type") == "purchase").alias("selected"),
    )
    memory = state.OrderedSampleMemory(ttl_ms=12 * 3600 * 1000)
    found = jobs.run_available(state.process_in_order(rows, memory, "2 days"), "ordered-memory")
    return found.withColumn("volatility", F.round("volatility", 6))


@query(
    "stream_phase_detect",
    f"""WITH {PHASES} SELECT user_id, event_id, round(score, 4) AS score, is_transition,
    round(CASE WHEN is_transition THEN least(score_mean / 4, 1.0::DOUBLE) ELSE 0 END, 4) AS confidence FROM det""",
)
def stream_phase_detect(spark, folder):
    rows = _stream(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("value") / 50).alias("norm"), F.cos(F.col("k") / 25).alias("alignment"),
        (F.col("value") / 100).alias("loss"), F.log(F.col("k") + 1).alias("entropy"),
    )
    found = jobs.run_available(state.process(rows, state.PhaseDetector()), "phases")
    return found.withColumns({"score": F.round("score", 4), "confidence": F.round("confidence", 4)})


@query(
    "stream_run_log",
    "SELECT event_type AS run, count(*) AS records, round(sum(value), 4) AS payload FROM events GROUP BY event_type",
)
def stream_run_log(spark, folder):
    """Each micro-batch is appended to a log under its number, so one that a restart repeats counts once."""
    path = scratch_path(spark, "stream-log")
    rows = _stream(spark, folder).select(
        F.col("event_type").alias("run"), F.lit("epoch").alias("kind"), F.col("event_id").alias("epoch"), "ts",
        F.col("value").alias("payload"),
    )
    (
        rows.writeStream.foreachBatch(lambda batch, number: runlog.append_log(batch, f"{path}/log", number))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    stored = runlog.read_log(spark, f"{path}/log")
    return stored.groupBy("run").agg(F.count("*").alias("records"), F.round(F.sum("payload"), 4).alias("payload"))
