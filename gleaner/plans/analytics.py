"""Run logs, reports, trials and strategy sweeps, over `events` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import analytics, combine, sweep
from gleaner.plans.base import query
from gleaner.plans.history import EV, KEY, SERIES, W, _round, _run_series, events
from gleaner.plans.signals import E, SIG, signal_table
from gleaner.functions import signals as S
from gleaner.session import materialise, scratch_path
from gleaner.sources import runlog
from gleaner.sources.tables import table

# SQL fragment: `runs` (run, epoch, accuracy, train_loss, val_loss, transition, strategy), a run per user.
RUNS = f"""
{EV},
runs AS (
  SELECT 'run' || user_id AS run, rn - 1 AS epoch, k::DOUBLE AS accuracy, value / 100 AS train_loss, value / 80 AS val_loss,
    k > 90 AS transition, event_type AS strategy, event_id, user_id, ts, value, k FROM ev)
"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    from gleaner.scale import over_history

    df = over_history(events(spark, folder), *KEY, 0, lambda d, w: d)
    return df.select(
        F.concat(F.lit("run"), "user_id").alias("run"), (F.col("_rank") - 1).alias("epoch"),
        F.col("k").cast("double").alias("accuracy"), (F.col("value") / 100).alias("train_loss"),
        (F.col("value") / 80).alias("val_loss"), (F.col("k") > 90).alias("transition"),
        F.col("event_type").alias("strategy"), "event_id", "user_id", "ts", "value", "k",
    )


# --- run logs ---------------------------------------------------------------------------


@query(
    "run_log_append",
    f"""WITH {RUNS} SELECT run, kind, count(*) AS records, max(epoch) AS last_epoch, round(sum(payload), 4) AS payload
    FROM (SELECT event_type AS run, epoch, ['epoch', 'strategy', 'timing', 'coreset'][(event_id % 4)::INT + 1] AS kind, value AS payload
      FROM runs JOIN events USING (event_id, value)) GROUP BY run, kind""",
)
def run_log_append(spark, folder):
    """Two batches appended to one log, the first one a second time by name and again by content: each counts once."""
    path = scratch_path(spark, "run-log")
    log = materialise(_log(spark, folder))
    even, odd = log.filter("epoch % 2 = 0"), log.filter("epoch % 2 = 1")
    runlog.append_log(even, path, "even")
    runlog.append_log(odd, path)
    runlog.append_log(even, path, "even")
    runlog.append_log(odd.repartition(3), path)
    stored = runlog.read_log(spark, path)
    return stored.groupBy("run", "kind").agg(
        F.count("*").alias("records"), F.max("epoch").alias("last_epoch"), F.round(F.sum("payload"), 4).alias("payload")
    )


def _log(spark, folder):
    kinds = F.array(*[F.lit(k) for k in runlog.KINDS])
    return runs(spark, folder).select(
        F.col("strategy").alias("run"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("kind"),
        "epoch", "ts", F.col("value").alias("payload"),
    )


@query(
    "run_summary",
    f"""WITH {RUNS} SELECT run, count(*) AS records, count(DISTINCT event_id % 4) AS kinds, round(sum(value), 4) AS payload
    FROM runs GROUP BY run""",
)
def run_summary(spark, folder):
    """JSON documents of each run, `chunk_records` records at most in one, read back and counted."""
    kinds = F.array(*[F.lit(k) for k in runlog.KINDS])
    log = runs(spark, folder).select(
        "run", F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("kind"), "epoch", "ts",
        F.col("value").alias("payload"),
    )
    documents = runlog.run_summary(log)
    schema = "struct<records:array<struct<epoch:bigint,ts:string,payload:double>>>"
    flat = documents.select("run", "kind", F.explode(F.from_json("document", schema)["records"]).alias("r"))
    return flat.groupBy("run").agg(
        F.count("*").alias("records"), F.countDistinct("kind").alias("kinds"), F.round(F.sum("r.payload"), 4).alias("payload")
    )


@query(
    "results_explode",
    f"""WITH {RUNS} SELECT run, epoch::BIGINT AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, accuracy AS val_accuracy, strategy FROM runs""",
)
def results_explode(spark, folder):
    """Flat rows to nested documents, through a JSON file, and back."""
    path = scratch_path(spark, "results")
    flat = runs(spark, folder).withColumnRenamed("accuracy", "val_accuracy")
    runlog.fold_results(flat).write.json(path)
    schema = (
        "dataset_name string, first_epoch bigint, train_losses array<double>, val_losses array<double>, "
        "val_accuracies array<double>, selection_strategies_used array<string>"
    )
    found = runlog.explode_results(spark.read.schema(schema).json(path))
    return _round(found.withColumn("epoch", F.col("epoch").cast("long")), ["train_loss", "val_loss"])


@query(
    "scalar_log",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events)
    SELECT event_type AS config, event_id, step, 'train/loss' AS tag, value FROM n
    UNION ALL SELECT event_type, event_id, step, 'train/double', value * 2 FROM n""",
)
def scalar_log(spark, folder):
    scalars = {"train/loss": F.col("value"), "train/double": F.col("value") * 2}
    return runlog.scalar_log(events(spark, folder), "event_type", "ts", "event_id", scalars)


@query(
    "metric_route",
    """WITH n AS (SELECT event_id, value, (['loss', 'gradient_norm', 'reward_diversity', 'usage_boundary', 'other'])[(event_id % 5)::INT + 1] AS name FROM events)
    SELECT event_id, CASE WHEN name LIKE 'reward%' THEN 'reward' WHEN name LIKE 'usage%' THEN 'usage' ELSE 'series' END AS kind,
      regexp_replace(name, '^(reward|usage)_', '') AS metric, value FROM n WHERE name <> 'other'""",
)
def metric_route(spark, folder):
    names = F.array(*[F.lit(n) for n in ("loss", "gradient_norm", "reward_diversity", "usage_boundary", "other")])
    named = events(spark, folder).select(
        "event_id", "value", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("name")
    )
    return runlog.route_metrics(named).select("event_id", "kind", "metric", "value")


@query("log_step_key", f"WITH {EV} SELECT event_id, k * 1000 + user_id AS step FROM ev")
def log_step_key(spark, folder):
    return events(spark, folder).select("event_id", runlog.step_key(F.col("k"), F.col("user_id")).alias("step"))


# --- timers -------------------------------------------------------------------------------


TIMER = """
timers AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'coreset_selection' WHEN 'N' THEN 'final_evaluation' ELSE 'training' END || '_' || l_linestatus AS timer,
    l_extendedprice / 1000 AS seconds, l_quantity, l_discount, l_shipdate, l_orderkey FROM lineitem)
"""


def timers(spark, folder) -> DataFrame:
    kind = (
        F.when(F.col("l_returnflag") == "A", "coreset_selection")
        .when(F.col("l_returnflag") == "N", "final_evaluation").otherwise("training")
    )
    return table(spark, folder, "lineitem").select(
        F.concat_ws("_", kind, "l_linestatus").alias("timer"), (F.col("l_extendedprice") / 1000).alias("seconds"),
        "l_quantity", "l_discount", "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber",
    )


@query(
    "timing_stats",
    f"""WITH {TIMER} SELECT timer, count(*) AS calls, round(sum(seconds), 4) AS total, round(avg(seconds), 6) AS mean,
    round(stddev_pop(seconds), 6) AS std, min(seconds) AS min, max(seconds) AS max, round(quantile_cont(seconds, 0.5), 6) AS median
    FROM timers GROUP BY timer""",
)
def timing_stats(spark, folder):
    found = analytics.timing_stats(timers(spark, folder).select("timer", "seconds"), "timer", "seconds")
    return _round(_round(found, ["total"], 4), ["mean", "std", "median"])


@query(
    "bottlenecks",
    f"""WITH {TIMER}, s AS (SELECT timer, sum(seconds) AS total, avg(seconds) AS avg_time, count(*) AS call_count FROM timers GROUP BY timer)
    SELECT timer, round(total, 4) AS total, round(avg_time, 6) AS avg_time, call_count, round(total / (SELECT sum(total) FROM s) * 100, 6) AS percentage,
      CASE WHEN contains(timer, 'coreset_selection') THEN 'Consider optimizing coreset selection algorithm or reducing selection frequency'
        WHEN contains(timer, 'evaluation') THEN 'Consider reducing evaluation frequency or using smaller validation sets'
        WHEN contains(timer, 'training') THEN 'Consider optimizing batch size or model architecture' END AS recommendation
    FROM s WHERE total / (SELECT sum(total) FROM s) > 0.1""",
)
def bottlenecks(spark, folder):
    found = analytics.bottlenecks(timers(spark, folder).select("timer", "seconds"), "timer", "seconds")
    return _round(_round(found, ["total"], 4), ["avg_time", "percentage"])


@query(
    "memory_latest",
    f"""WITH {EV} SELECT event_type AS name, value AS allocated, k AS reserved FROM ev
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def memory_latest(spark, folder):
    df = events(spark, folder).withColumnRenamed("event_type", "name")
    return analytics.memory_latest(df, "name", "ts", "event_id", "value", "k")


@query("counters", f"WITH {EV} SELECT event_type AS name, sum(k)::BIGINT AS value FROM ev GROUP BY event_type")
def counters(spark, folder):
    df = events(spark, folder).select(F.col("event_type").alias("name"), "k")
    return analytics.counters(df, "name", "k")


# --- runs -----------------------------------------------------------------------------------


ROLLUP = """
roll AS (
  SELECT run, arg_max(accuracy, epoch) AS final_accuracy, max(accuracy) AS best_accuracy, arg_max(val_loss, epoch) AS final_loss,
    count(*) FILTER (WHERE transition) AS num_transitions, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies
  FROM runs GROUP BY run)
"""


@query("run_rollup", f"WITH {RUNS}, {ROLLUP} SELECT * REPLACE (round(final_loss, 6) AS final_loss) FROM roll")
def run_rollup(spark, folder):
    return _round(_rollup(spark, folder), ["final_loss"])


def _rollup(spark, folder):
    return analytics.run_rollup(runs(spark, folder), "run", "epoch", "accuracy", "val_loss", "transition", "strategy")


@query(
    "reward_delta",
    f"""WITH {EV}, b AS (
      SELECT event_id, k / 100 AS a, value / 100 AS l, exp(value / 100) AS p, k / 50 AS d, k / 60 AS f,
        lag(k / 100) OVER {W()} AS a0, lag(value / 100) OVER {W()} AS l0, lag(exp(value / 100)) OVER {W()} AS p0 FROM ev),
    r AS (SELECT *, (p0 - p) / (p0 + 1e-8) AS rp, (l0 - l) / (l0 + 1e-8) AS rl FROM b)
    SELECT event_id, round(a - a0, 6) AS reward_accuracy, round(0.7::DOUBLE * (a - a0) + 0.3::DOUBLE * (l0 - l), 6) AS reward_mixed,
      round(0.5::DOUBLE * rp + 0.5::DOUBLE * rl, 4) AS reward_relative, round(0.5::DOUBLE * rp + 0.5::DOUBLE * rl + 0.5::DOUBLE * rp, 4) AS reward_feedback,
      round(0.4::DOUBLE * (p0 - p) + 0.3::DOUBLE * (l0 - l) + 0.2::DOUBLE * d + 0.1::DOUBLE * f, 6) AS reward_objectives FROM r""",
)
def reward_delta(spark, folder):
    df = events(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("k") / 100).alias("accuracy"), (F.col("value") / 100).alias("loss"),
        F.exp(F.col("value") / 100).alias("perplexity"), (F.col("k") / 50).alias("downstream"), (F.col("k") / 60).alias("efficiency"),
    )
    names = ["reward_accuracy", "reward_mixed", "reward_relative", "reward_feedback", "reward_objectives"]
    found = analytics.reward_delta(df, *KEY).select("event_id", *names)
    return _round(_round(found, names[2:4], 4), [*names[:2], names[4]])


@query(
    "reward_by_weight",
    f"""WITH {EV}, g AS (SELECT event_id, user_id, rn, k - lag(k) OVER {W()} AS gain FROM ev)
    SELECT user_id, event_id, strategy, round(gain * usage, 6) AS reward, usage
    FROM g, (VALUES ('grad_mag', 0.4::DOUBLE), ('diversity', 0.35::DOUBLE), ('uncertainty', 0.25::DOUBLE)) w(strategy, usage) WHERE rn > 1""",
)
def reward_by_weight(spark, folder):
    weights = {"grad_mag": 0.4, "diversity": 0.35, "uncertainty": 0.25}
    df = events(spark, folder).select("user_id", "ts", "event_id", "k")
    return _round(analytics.reward_by_weight(df, weights, *KEY, "k"), ["reward"])


@query(
    "env_reward",
    f"""WITH {EV} SELECT event_id, round(10 * coalesce(lag(value / 100) OVER {W()} - value / 100, 0) + 2 * (1 - k / 100)
      + -0.1::DOUBLE * ((k % 3) / greatest(k % 5, 1)) + -0.5::DOUBLE * greatest(0, k / 100 - 0.8::DOUBLE)
      + -0.5::DOUBLE * greatest(0, k / 120 - 0.7::DOUBLE) + 0.1::DOUBLE * (k / 300 + k / 400), 6) AS reward FROM ev""",
)
def env_reward(spark, folder):
    k = F.col("k")
    df = events(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("value") / 100).alias("perplexity"), k.alias("selected"), F.lit(100).alias("budget"),
        (k % 3).alias("violations"), (k % 5).alias("checks"), (k / 100).alias("memory"), F.lit(0.8).alias("memory_budget"),
        (k / 120).alias("compute"), F.lit(0.7).alias("compute_budget"), F.array(k / 200, k / 300, k / 400).alias("weights"),
    )
    return _round(analytics.env_reward(df, *KEY).select("event_id", "reward"), ["reward"])


@query("strategy_usage", "SELECT event_type AS strategy, count(DISTINCT user_id) AS uses FROM events GROUP BY event_type")
def strategy_usage(spark, folder):
    """In how many runs each strategy was used."""
    used = events(spark, folder).groupBy("user_id").agg(F.collect_set("event_type").alias("strategies"))
    return analytics.strategy_usage(used, "strategies")


@query(
    "strategy_effect",
    f"WITH {RUNS} SELECT strategy, round(avg(accuracy), 6) AS mean_accuracy, count(*) AS epochs FROM runs GROUP BY strategy",
)
def strategy_effect(spark, folder):
    df = events(spark, folder).select(F.col("event_type").alias("strategy"), F.col("k").cast("double").alias("accuracy"))
    return _round(analytics.strategy_effect(df, "strategy", "accuracy"), ["mean_accuracy"])


@query(
    "transitions_per_run",
    f"WITH {EV} SELECT user_id, count(*) FILTER (WHERE k > 90) AS transitions FROM ev GROUP BY user_id",
)
def transitions_per_run(spark, folder):
    df = events(spark, folder).select("user_id", (F.col("k") > 90).alias("t"))
    return analytics.transitions_per_run(df, "user_id", "t")


@query(
    "transition_histogram",
    f"""WITH {EV}, n AS (SELECT user_id, count(*) FILTER (WHERE k > 90) AS transitions FROM ev GROUP BY user_id)
    SELECT transitions, count(*) AS runs FROM n GROUP BY transitions""",
)
def transition_histogram(spark, folder):
    df = events(spark, folder).select("user_id", (F.col("k") > 90).alias("t"))
    return analytics.transition_histogram(df, "user_id", "t")


NAMED = f"""
named AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'seta' ELSE 'setb' END || '_' || event_type || '_noise_sev' || (1 + k % 5) AS run, k AS accuracy
  FROM ev)
"""


def _named_runs(spark, folder):
    df = events(spark, folder)
    sev = 1 + F.col("k") % 5
    name = F.concat(
        F.when(F.col("user_id") % 2 == 0, "seta").otherwise("setb"), F.lit("_"), "event_type", F.lit("_noise_sev"), sev.cast("string")
    )
    return df.select(name.alias("run"), F.col("k").alias("accuracy"))


def _sev(s: int) -> str:
    return f"coalesce(avg(accuracy) FILTER (WHERE sev = {s}), 0)"


@query(
    "robustness_pivot",
    rf"""WITH {EV}, {NAMED}, p AS (SELECT *, split_part(run, '_', 1) AS dataset, regexp_extract(run, '^[^_]+_(.+)_sev', 1) AS corruption,
      regexp_extract(run, 'sev(\d+)$', 1)::INT AS sev FROM named)
    SELECT dataset, corruption, {", ".join(f"round({_sev(s)}, 6) AS sev{s}" for s in range(1, 6))},
      round(({" + ".join(_sev(s) for s in range(1, 6))}) / 5, 6) AS mean_accuracy FROM p GROUP BY dataset, corruption""",
)
def robustness_pivot(spark, folder):
    found = analytics.robustness_pivot(_named_runs(spark, folder), "run", "accuracy", range(1, 6))
    return _round(found, [*[f"sev{s}" for s in range(1, 6)], "mean_accuracy"])


@query(
    "robustness_cube",
    rf"""WITH {EV}, {NAMED}, p AS (SELECT *, regexp_extract(run, '^[^_]+_(.+)_sev', 1) AS corruption, regexp_extract(run, 'sev(\d+)$', 1)::INT AS severity FROM named)
    SELECT corruption, severity, round(avg(accuracy), 6) AS mean_accuracy, count(*) AS runs FROM p GROUP BY CUBE (corruption, severity)""",
)
def robustness_cube(spark, folder):
    return _round(analytics.robustness_cube(_named_runs(spark, folder), "run", "accuracy"), ["mean_accuracy"])


@query("best_run", f"WITH {RUNS}, {ROLLUP} SELECT run, final_accuracy FROM roll ORDER BY final_accuracy DESC, run LIMIT 1")
def best_run(spark, folder):
    return analytics.best_run(_rollup(spark, folder), "run", "final_accuracy")


@query(
    "improvement_vs_first",
    f"""WITH {EV} SELECT event_id, round(value - first_value(value) OVER {W()}, 6) AS improvement,
    max(value) OVER {W("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")} AS best FROM ev""",
)
def improvement_vs_first(spark, folder):
    df = events(spark, folder).select("user_id", "ts", "event_id", "value")
    return _round(analytics.improvement_vs_first(df, *KEY, "value").select("event_id", "improvement", "best"), ["improvement"])


@query(
    "config_compare",
    f"""WITH {RUNS}, c AS (SELECT run, min(value) AS best_perplexity, arg_min(value, epoch) AS first_perplexity, arg_max(value, epoch) AS final_perplexity,
      avg(k) AS avg_selection_time, avg(k * 2) AS avg_training_time FROM runs GROUP BY run)
    SELECT run, best_perplexity, first_perplexity, final_perplexity, round(avg_selection_time, 6) AS avg_selection_time, round(avg_training_time, 6) AS avg_training_time,
      round(CASE WHEN first_perplexity > final_perplexity THEN (first_perplexity - final_perplexity) / first_perplexity * 100 END, 6) AS improvement_pct FROM c""",
)
def config_compare(spark, folder):
    df = runs(spark, folder).withColumn("k2", F.col("k") * 2)
    found = analytics.config_compare(df, "run", "epoch", "value", "k", "k2")
    return _round(found, ["avg_selection_time", "avg_training_time", "improvement_pct"])


@query(
    "epoch_improvement",
    f"WITH {EV} SELECT event_id, round((lag(value) OVER {W()} - value) / nullif(lag(value) OVER {W()}, 0), 4) AS improvement FROM ev",
)
def epoch_improvement(spark, folder):
    df = events(spark, folder).select("user_id", "ts", "event_id", "value")
    return _round(analytics.epoch_improvement(df, *KEY, "value").select("event_id", "improvement"), ["improvement"], 4)


@query(
    "budget_efficiency",
    f"""WITH {EV}, b AS (SELECT (1 + user_id % 5) / 10 AS budget_ratio, sum(value) AS reward, sum(k % 3)::BIGINT AS violations, count(*) AS checks FROM ev GROUP BY 1)
    SELECT budget_ratio, round(reward, 4) AS reward, violations, checks, round(reward / (budget_ratio * (SELECT count(*) FROM events)), 6) AS data_efficiency,
      round(violations / checks, 6) AS violation_rate FROM b""",
)
def budget_efficiency(spark, folder):
    per_budget = events(spark, folder).groupBy(((1 + F.col("user_id") % 5) / 10).alias("budget_ratio")).agg(
        F.sum("value").alias("reward"), F.sum(F.col("k") % 3).alias("violations"), F.count("*").alias("checks")
    )
    found = analytics.budget_efficiency(per_budget, events(spark, folder).agg(F.count("*")).scalar())
    return _round(_round(found, ["reward"], 4), ["data_efficiency", "violation_rate"])


# --- trials -----------------------------------------------------------------------------------


_PH = "(['early', 'middle', 'late', 'transition'])[(user_id % 4)::INT + 1]"
_WS = ", ".join(f"((event_id * {i + 3} + k * {i + 1}) % 97) / 97" for i in range(6))
TRIALS = f"""
{EV},
trials AS (
  SELECT event_id, {_PH} AS phase, value AS score, [{_WS}] AS weights, k / 100 AS accuracy, (k % 7) / 7 AS diversity,
    (k % 11) / 11 AS compression, (k % 13) / 13 AS speed, (k % 17) / 17 AS hard_coverage, (k % 19) / 19 AS loss_variance FROM ev),
top AS (
  SELECT * FROM trials QUALIFY row_number() OVER (PARTITION BY phase ORDER BY score DESC, event_id)
    <= greatest(1, count(*) OVER (PARTITION BY phase) // 10))
"""


def trials(spark, folder) -> DataFrame:
    df = events(spark, folder)
    k, e = F.col("k"), F.col("event_id")
    names = F.array(*[F.lit(p) for p in ("early", "middle", "late", "transition")])
    weights = F.array(*[((e * (i + 3) + k * (i + 1)) % 97) / 97 for i in range(6)])
    return df.select(
        "event_id", F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("phase"), F.col("value").alias("score"),
        weights.alias("weights"), (k / 100).alias("accuracy"), (k % 7 / 7).alias("diversity"), (k % 11 / 11).alias("compression"),
        (k % 13 / 13).alias("speed"), (k % 17 / 17).alias("hard_coverage"), (k % 19 / 19).alias("loss_variance"),
    )


def _top(spark, folder):
    return analytics.trial_top_decile(trials(spark, folder).select("event_id", "phase", "score", "weights"), "phase", "score", "event_id")


@query("trial_top_decile", f"WITH {TRIALS} SELECT event_id, phase, score FROM top")
def trial_top_decile(spark, folder):
    return _top(spark, folder).select("event_id", "phase", "score")


_PAIRS = [(i, j) for i in range(6) for j in range(i + 1, 6)]
_N = combine.PHASE_SCORES
CORR = " UNION ALL ".join(
    f"SELECT '{_N[i]}' AS score1, '{_N[j]}' AS score2, corr(weights[{i + 1}], weights[{j + 1}]) AS corr FROM top" for i, j in _PAIRS
)


@query("weight_correlation", f"WITH {TRIALS}, c AS ({CORR}) SELECT score1, score2, round(corr, 6) AS corr FROM c WHERE abs(corr) > 0.005")
def weight_correlation(spark, folder):
    """Among the best trials; a low threshold, as their weights are nearly independent."""
    return _round(analytics.weight_correlations(_top(spark, folder), "weights", threshold=0.005), ["corr"])


_MEANS = ", ".join(f"avg(weights[{i + 1}])" for i in range(6))
_LABELS = ", ".join(f"'{n}'" for n in _N)
DOM = f"dom AS (SELECT phase, ([{_LABELS}])[list_position(m, list_max(m))] AS dominant, list_max(m) AS mean_weight FROM (SELECT phase, [{_MEANS}] AS m FROM top GROUP BY phase))"


@query("phase_dominance", f"WITH {TRIALS}, {DOM} SELECT phase, dominant, round(mean_weight, 6) AS mean_weight FROM dom")
def phase_dominance(spark, folder):
    return _round(analytics.phase_dominance(_top(spark, folder), "phase", "weights"), ["mean_weight"])


@query(
    "composite_strategies",
    f"""WITH {TRIALS}, {DOM}, c AS ({CORR}), s AS (SELECT unnest([{_LABELS}]) AS score)
    SELECT score1 || '_' || score2 || '_synergy' AS name, score, CASE WHEN score IN (score1, score2) THEN 0.4 ELSE 0.1 END::DOUBLE AS weight
    FROM c, s WHERE corr > 0.005
    UNION ALL SELECT phase || '_optimized', score, CASE WHEN score = dominant THEN 0.5 ELSE 0.1 END::DOUBLE FROM dom, s WHERE phase <> 'transition'""",
)
def composite_strategies(spark, folder):
    top = materialise(_top(spark, folder))
    found = analytics.weight_correlations(top, "weights", threshold=0.005)
    dominance = analytics.phase_dominance(top.filter("phase <> 'transition'"), "phase", "weights")
    return analytics.composite_strategies(found, dominance, "phase")


@query(
    "phase_objective",
    f"""WITH {TRIALS} SELECT event_id, round(CASE phase WHEN 'early' THEN 0.7::DOUBLE * accuracy + 0.3::DOUBLE * diversity
      WHEN 'middle' THEN 0.6::DOUBLE * accuracy + 0.2::DOUBLE * compression + 0.2::DOUBLE * speed
      WHEN 'late' THEN 0.8::DOUBLE * accuracy + 0.2::DOUBLE * hard_coverage ELSE 0.5::DOUBLE * accuracy + 0.5::DOUBLE * (1 - loss_variance) END, 6) AS objective FROM trials""",
)
def phase_objective(spark, folder):
    df = trials(spark, folder)
    return df.select("event_id", F.round(combine.phase_objective(F.col("phase")), 6).alias("objective"))


_DEFAULTS = " ".join(f"WHEN '{p}' THEN [{', '.join(str(w) for w in ws)}]::DOUBLE[]" for p, ws in combine.PHASE_WEIGHTS.items())
_MIDDLE = f"[{', '.join(str(w) for w in combine.PHASE_WEIGHTS['middle'])}]::DOUBLE[]"
DEFAULTS = f"""
{EV},
dw AS (
  SELECT event_id, value, k, CASE CASE WHEN user_id % 5 = 4 THEN 'unknown' ELSE {_PH} END {_DEFAULTS} ELSE {_MIDDLE} END AS w FROM ev)
"""


def _default_weights(spark, folder):
    names = F.array(*[F.lit(p) for p in ("early", "middle", "late", "transition")])
    phase = F.when(F.col("user_id") % 5 == 4, "unknown").otherwise(F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")))
    return events(spark, folder).select("event_id", "value", "k", combine.phase_weights(phase).alias("w"))


def _spread(df, digits=6):
    return df.select("event_id", *[F.round(F.get("w", F.lit(i)), digits).alias(n) for i, n in enumerate(_N)])


def _spread_sql(w: str) -> str:
    return ", ".join(f"round({w}[{i + 1}], 6) AS {n}" for i, n in enumerate(_N))


@query("phase_default_weights", f"WITH {DEFAULTS} SELECT event_id, {_spread_sql('w')} FROM dw")
def phase_default_weights(spark, folder):
    """A fifth of the users have a phase without defaults."""
    return _spread(_default_weights(spark, folder))


@query(
    "adjust_weights",
    f"""WITH {DEFAULTS}, f AS (SELECT event_id, w, [CASE WHEN value > 50 THEN 1.1 ELSE 1 END, 1, 1, 1,
      CASE WHEN k / 500 > 0.1 THEN 1.2 ELSE 1 END, CASE WHEN k / 200 > 0.3 THEN 1.3 ELSE 1 END]::DOUBLE[] AS f FROM dw),
    r AS (SELECT event_id, list_transform(w, lambda v, i: v * f[i]) AS r FROM f),
    n AS (SELECT event_id, list_transform(r, lambda v: v / list_sum(r)) AS n FROM r)
    SELECT event_id, {_spread_sql('n')} FROM n""",
)
def adjust_weights(spark, folder):
    df = _default_weights(spark, folder)
    raised = combine.adjusted_weights(F.col("w"), F.col("value"), F.lit(50.0), F.col("k") / 500, F.col("k") / 200)
    return _spread(df.select("event_id", raised.alias("w")))


@query(
    "normalise_weights",
    """WITH w AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, round(weight / (sum(weight) OVER (PARTITION BY l_orderkey) + 1e-8), 6) AS share FROM w""",
)
def normalise_weights(spark, folder):
    """Order lines as the weight vector of a round."""
    weights = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("weight"))
    found = combine.normalise_weights(weights, ["l_orderkey"])
    return _round(found.select("l_orderkey", "l_linenumber", "share"), ["share"])


@query(
    "dominant_weight",
    """WITH w AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_linenumber AS dominant, weight FROM w
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, l_linenumber) = 1""",
)
def dominant_weight(spark, folder):
    weights = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("weight"))
    return combine.dominant_weight(weights, ["l_orderkey"], "l_linenumber", "weight", "l_linenumber")


@query(
    "class_imbalance",
    "SELECT round(1 - min(n) / max(n), 6) AS class_imbalance FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)",
)
def class_imbalance(spark, folder):
    return _round(combine.class_imbalance(table(spark, folder, "embeddings"), "label"), ["class_imbalance"])


@query(
    "curriculum_combine",
    r"""WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, n_chars FROM documents)
    SELECT doc_id, round(0.5::DOUBLE * least(n_chars / 5000, 1.0::DOUBLE)
      + 0.3::DOUBLE * (CASE WHEN n < 100 THEN 0.2 WHEN n < 300 THEN 0.5 ELSE 0.3 END)::DOUBLE * (n / 1000), 6) AS score FROM d""",
)
def curriculum_combine(spark, folder):
    from gleaner.functions import text as T

    docs = table(spark, folder, "documents").select("doc_id", "n_chars", F.size(T.words_of(F.col("text"))).alias("n"))
    scores = {"quality": F.least(F.col("n_chars") / 5000, F.lit(1.0)), "difficulty": F.col("n") / 1000}
    score = combine.curriculum_sum(
        scores, {"quality": 0.5, "difficulty": 0.3}, T.difficulty_level(F.col("n")), {"easy": 0.2, "medium": 0.5, "hard": 0.3}
    )
    return docs.select("doc_id", F.round(score, 6).alias("score"))


@query(
    "weight_history",
    """WITH w AS (SELECT user_id AS round, event_type AS name, avg(value) AS weight FROM events GROUP BY ALL)
    SELECT round, round(max(weight) FILTER (WHERE name = 'click'), 6) AS click, round(max(weight) FILTER (WHERE name = 'error'), 6) AS error,
      round(max(weight) FILTER (WHERE name = 'purchase'), 6) AS purchase, round(max(weight) FILTER (WHERE name = 'signup'), 6) AS signup,
      round(max(weight) FILTER (WHERE name = 'view'), 6) AS view FROM w GROUP BY round""",
)
def weight_history(spark, folder):
    names = ["click", "error", "purchase", "signup", "view"]
    weights = events(spark, folder).groupBy(F.col("user_id").alias("round"), F.col("event_type").alias("name")).agg(
        F.avg("value").alias("weight")
    )
    return _round(analytics.weight_history(weights, "round", "name", "weight", names), names)


@query(
    "weight_history_long",
    """WITH w AS (SELECT user_id AS round, event_type AS name, avg(value) AS weight FROM events GROUP BY ALL),
    r AS (SELECT DISTINCT round FROM w), n AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS name)
    SELECT round, name, round(weight, 6) AS weight FROM r CROSS JOIN n LEFT JOIN w USING (round, name)""",
)
def weight_history_long(spark, folder):
    names = ["click", "error", "purchase", "signup", "view"]
    return analytics.weight_history_long(weight_history(spark, folder), "round", names)


# --- sweeps -----------------------------------------------------------------------------------


SWEEP_SCORES = ("grad", "unc", "conf")


def _sweep_rows(spark, folder):
    p, y, x = F.col("p"), F.col("y"), F.col("x")
    return signal_table(spark, folder).select(
        "id", "loss", S.grad_magnitude(p, y, x).alias("grad"), S.uncertainty(p).alias("unc"), F.array_max("p").alias("conf")
    )


_U = "(('0x' || substr(md5({0}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496)"


def _u(*parts: str) -> str:
    return _U.format(" || ':' || ".join(parts))


def _term(i: str) -> str:
    return (
        f"{{'score': (['grad', 'unc', 'conf'])[floor({_u(chr(39) + '0' + chr(39), chr(39) + 'score' + chr(39), 's', i)} * 3)::INT + 1], "
        f"'op': (['add', 'multiply', 'max', 'min'])[floor({_u(chr(39) + '0' + chr(39), chr(39) + 'op' + chr(39), 's', i)} * 4)::INT + 1], "
        f"'weight': 0.1::DOUBLE + 0.9::DOUBLE * {_u(chr(39) + '0' + chr(39), chr(39) + 'weight' + chr(39), 's', i)}}}"
    )


_LEN = f"floor({_u(chr(39) + '0' + chr(39), chr(39) + 'length' + chr(39), 's')} * 2)::INT + 2"
_VAL = "(CASE t{0}.score WHEN 'grad' THEN grad WHEN 'unc' THEN unc ELSE conf END) * t{0}.weight"


def _fold(left: str, i: int) -> str:
    v = _VAL.format(i)
    return f"(CASE t{i}.op WHEN 'add' THEN {left} + {v} WHEN 'multiply' THEN {left} * ({v}) WHEN 'max' THEN greatest({left}, {v}) ELSE least({left}, {v}) END)"


SWEEP = f"""
{SIG},
rows_ AS (SELECT id, loss, sqrt(list_dot_product(err, err)) * sqrt(list_dot_product(x, x)) AS grad,
  -list_sum(list_transform(p, lambda v: v * ln(v + 1e-8))) AS unc, list_max(p) AS conf FROM sig),
pop AS (SELECT s, {_LEN} AS n, {_term("1")} AS t1, {_term("2")} AS t2, {_term("3")} AS t3 FROM (SELECT unnest(range(0, 50)) AS s)),
two AS (SELECT s, n, t3, id, loss, grad, unc, conf, {_fold(_VAL.format(1), 2)} AS f2 FROM rows_, pop),
three AS (SELECT s, id, loss, CASE WHEN n = 2 THEN f2 ELSE {_fold("f2", 3)} END AS score FROM two),
fit AS (SELECT s AS strategy, avg(loss) AS fitness FROM (
  SELECT * FROM three QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, id) <= 50) GROUP BY s)
"""


@query("sweep_evaluate", f"WITH {SWEEP} SELECT strategy::INT AS strategy, round(fitness, 6) AS fitness FROM fit")
def sweep_evaluate(spark, folder):
    """Mean loss of the 50 rows that each of 50 strategies ranks highest."""
    population = sweep.initial_population(spark, SWEEP_SCORES)
    return _round(sweep.evaluate(_sweep_rows(spark, folder), population, "id", "loss", 50), ["fitness"])


@query(
    "sweep_tournament",
    f"""WITH {SWEEP}, entered AS (
      SELECT slot, strategy, fitness, row_number() OVER (PARTITION BY slot ORDER BY md5('0:' || slot || ':' || strategy), strategy) AS place
      FROM fit, (SELECT unnest(range(1, 50)) AS slot)),
    w AS (SELECT slot, strategy, fitness FROM entered WHERE place <= 5 UNION ALL SELECT 0, strategy, fitness FROM fit)
    SELECT slot::INT AS slot, strategy::INT AS winner, round(fitness, 6) AS fitness FROM w
    QUALIFY row_number() OVER (PARTITION BY slot ORDER BY w.fitness DESC, strategy) = 1""",
)
def sweep_tournament(spark, folder):
    fitness = sweep.evaluate(_sweep_rows(spark, folder), sweep.initial_population(spark, SWEEP_SCORES), "id", "loss", 50)
    return _round(sweep.tournament(materialise(fitness), 50), ["fitness"])


def _fitness(g: int) -> str:
    """Fitness of generation `g`, from its population `pop<g>`."""
    return f"""two{g} AS (SELECT s, n, t3, id, loss, grad, unc, conf, {_fold(_VAL.format(1), 2)} AS f2 FROM rows_, pop{g}),
three{g} AS (SELECT s, id, loss, CASE WHEN n = 2 THEN f2 ELSE {_fold("f2", 3)} END AS score FROM two{g}),
fit{g} AS MATERIALIZED (SELECT s, round(avg(loss), 9) AS fitness FROM (
  SELECT * FROM three{g} QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, id) <= 50) GROUP BY s)"""


def _mutated(i: int, seed: str) -> str:
    """Term `i` of a child, from 0: its weight shifted or not, its operator redrawn or not; slot 0 stays."""
    u = lambda *parts: _u(f"'{seed}'", *parts)
    t, at = f"t{i + 1}", f"'{i}'"
    noise = f"sqrt(-2 * ln(1 - {u(chr(39) + 'r' + chr(39), 's', at)})) * cos(2 * pi() * {u(chr(39) + 'a' + chr(39), 's', at)})"
    redraw = f"{u(chr(39) + 'redraw' + chr(39), 's')} < 0.1::DOUBLE AND {i} = floor({u(chr(39) + 'which' + chr(39), 's')} * (n - 1))::INT + 1"
    operator = f"(['add', 'multiply', 'max', 'min'])[floor({u(chr(39) + 'op' + chr(39), 's')} * 4)::INT + 1]"
    shift = f"{u(chr(39) + 'mutate' + chr(39), 's', at)} < 0.1::DOUBLE"
    return f"""{{'score': {t}.score, 'op': CASE WHEN s > 0 AND {redraw} THEN {operator} ELSE {t}.op END,
      'weight': CASE WHEN s > 0 AND {shift} THEN least(1::DOUBLE, greatest(0::DOUBLE, {t}.weight + 0.1::DOUBLE * {noise})) ELSE {t}.weight END}}"""


def _breed(g: int, seed: str) -> str:
    """The population after generation `g`: winners of tournaments, mutated."""
    return f"""entered{g} AS (SELECT slot, s, fitness, row_number() OVER (PARTITION BY slot ORDER BY md5('{seed}:' || slot || ':' || s), s) AS place
  FROM fit{g}, (SELECT unnest(range(1, 50)) AS slot)),
won{g} AS (SELECT slot, s FROM (SELECT slot, s, fitness FROM entered{g} WHERE place <= 5 UNION ALL SELECT 0, s, fitness FROM fit{g})
  QUALIFY row_number() OVER (PARTITION BY slot ORDER BY fitness DESC, s) = 1),
parents{g} AS (SELECT won{g}.slot AS s, n, t1, t2, t3 FROM won{g} JOIN pop{g} ON won{g}.s = pop{g}.s),
pop{g + 1} AS MATERIALIZED (SELECT s, n, {_mutated(0, seed)} AS t1, {_mutated(1, seed)} AS t2, {_mutated(2, seed)} AS t3 FROM parents{g})"""


_FIRST = f"{SWEEP}, pop0 AS (SELECT * FROM pop), {_fitness(0)}"


@query(
    "sweep_mutate",
    f"WITH {_FIRST}, {_breed(0, '0')}, {_fitness(1)} SELECT s::INT AS strategy, round(fitness, 6) AS fitness FROM fit1",
)
def sweep_mutate(spark, folder):
    """Fitness of the next generation."""
    rows = materialise(_sweep_rows(spark, folder))
    population = sweep.initial_population(spark, SWEEP_SCORES)
    fitness = materialise(_round(sweep.evaluate(rows, population, "id", "loss", 50), ["fitness"], 9))
    following = sweep.next_generation(population, fitness, 50)
    return _round(sweep.evaluate(rows, following, "id", "loss", 50), ["fitness"])


GENERATIONS, PATIENCE = 5, 3


def _evolution() -> str:
    steps = [_FIRST]
    for g in range(1, GENERATIONS):
        steps += [_breed(g - 1, f"0:{g - 1}"), _fitness(g)]
    every = " UNION ALL ".join(f"SELECT {g} AS generation, pop{g}.s, fitness, n, t1, t2, t3 FROM pop{g} JOIN fit{g} USING (s)" for g in range(GENERATIONS))
    return f"""WITH {", ".join(steps)}, every AS ({every}),
    history AS (SELECT generation, first(s ORDER BY fitness DESC, s) AS strategy, max(fitness) AS best, avg(fitness) AS mean,
      count(DISTINCT CASE WHEN n = 2 THEN [t1, t2] ELSE [t1, t2, t3] END) AS distinct_strategies FROM every GROUP BY generation),
    grown AS (SELECT *, generation = 0 OR best > max(best) OVER (ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM history),
    stale AS (SELECT *, generation - max(CASE WHEN up THEN generation END) OVER (ORDER BY generation) AS still FROM grown)
    SELECT generation::INT AS generation, strategy::INT AS strategy, round(best, 6) AS best, round(mean, 6) AS mean, distinct_strategies
    FROM (SELECT *, coalesce(max(still) OVER (ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM stale)
    WHERE before < {PATIENCE}"""


@query("sweep_evolve", _evolution())
def sweep_evolve(spark, folder):
    """Up to five generations of 50 strategies; it stops when the best one has not improved three times in a row."""
    found = sweep.evolve(
        _sweep_rows(spark, folder), sweep.initial_population(spark, SWEEP_SCORES), "id", "loss", 50, GENERATIONS, patience=PATIENCE
    )
    return _round(found.history(spark).drop("terms"), ["best", "mean"])
