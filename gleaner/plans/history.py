"""Queries on histories and runs, over `events`.

A user's events in time order are the history of a sample or the steps of a run;
`value` and the number in `props` supply the logged quantities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.operators import analytics, combine, dedup, greedy, history, metrics, phases, select
from gleaner.plans.base import query
from gleaner.scale import numeric_order, over_history
from gleaner.scale.frames import Carry
from gleaner.session import materialise
from gleaner.sources.tables import table

KEY = (["user_id"], "ts", "event_id")

# SQL fragments: `ev` (events, k, rn), `steps` (run series).
EV = r"""
ev AS (
  SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
"""


def W(frame: str = "") -> str:
    return f"(PARTITION BY user_id ORDER BY rn {frame})"


def last(n: int) -> str:
    return W(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def events(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events")
    return df.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))


def _round(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def checksum(values):
    """Position-weighted sum, to compare a vector by one number."""
    return F.round(V.total(F.transform(values, lambda v, i: v * (i + 1))), 4)


def checksum_sql(values: str) -> str:
    return f"round(list_sum(list_transform({values}, lambda v, i: v * i)), 4)"


# --- sample memory --------------------------------------------------------------------


@query(
    "forgetting",
    f"""WITH {EV}, r AS (SELECT *, coalesce((value > lag(value) OVER {W()})::INT, 0) AS rose FROM ev)
    SELECT event_id, round(CASE WHEN rn > 1 THEN (sum(rose) OVER {last(9)})::DOUBLE / (least(rn, 10) - 1)
      ELSE 0 END, 6) AS forgetting FROM r""",
)
def forgetting(spark, folder):
    found = history.forgetting(events(spark, folder), *KEY, "value")
    return _round(found.select("event_id", "forgetting"), ["forgetting"])


MEMORY = f"""
mem AS (
  SELECT user_id, event_id, rn - 1 AS step, CASE WHEN rn > 1 THEN var_pop(value / 7) OVER {last(10)} ELSE 0 END AS volatility,
    rn - 1 - coalesce(max(CASE WHEN event_type = 'purchase' THEN rn - 1 END)
      OVER {W("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")}, 0) AS staleness,
    coalesce(avg(CASE WHEN event_type = 'click' THEN value END) OVER {W("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")}, 0) AS impact_mean,
    max((event_type = 'purchase')::INT) OVER {W("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")} = 1 AS ever
  FROM ev),
latest AS (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step DESC) = 1)
"""


def memory(spark, folder) -> DataFrame:
    """Purchases are selections, clicks log an impact; the uncertainty is value / 7."""
    df = events(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("value") / 7).alias("uncertainty"),
        (F.col("event_type") == "purchase").alias("selected"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("impact"),
    )
    return history.sample_memory(df, *KEY)


@query("volatility", f"WITH {EV}, {MEMORY} SELECT event_id, round(volatility, 4) AS volatility FROM mem")
def volatility(spark, folder):
    return _round(memory(spark, folder).select("event_id", "volatility"), ["volatility"], 4)


@query("staleness", f"WITH {EV}, {MEMORY} SELECT event_id, step, staleness FROM mem")
def staleness(spark, folder):
    return memory(spark, folder).select("event_id", "step", "staleness")


@query("impact_mean", f"WITH {EV}, {MEMORY} SELECT event_id, round(impact_mean, 6) AS impact_mean FROM mem")
def impact_mean(spark, folder):
    return _round(memory(spark, folder).select("event_id", "impact_mean"), ["impact_mean"])


@query(
    "memory_stats",
    f"""WITH {EV}, {MEMORY} SELECT round(avg(volatility), 4) AS volatility_mean, round(stddev_pop(volatility), 4) AS volatility_std,
    round(avg((NOT ever)::INT), 6) AS exploration_potential, round(avg(staleness), 6) AS average_staleness FROM latest""",
)
def memory_stats(spark, folder):
    found = history.memory_stats(memory(spark, folder), "user_id")
    found = _round(found, ["volatility_mean", "volatility_std"], 4)
    return _round(found, ["exploration_potential", "average_staleness"])


def _bits_sql(capacity: int) -> str:
    bits, hashes = dedup.filter_size(capacity)
    wrap = (1 << 64) % bits
    digest = "md5(h || i::VARCHAR)"
    half = lambda a: f"('0x' || substr({digest}, {a}, 16))::UBIGINT"
    return f"""SELECT count(DISTINCT ((({half(1)} % {bits})::HUGEINT * {wrap} + ({half(17)} % {bits})) % {bits})) AS bits_set
      FROM (SELECT h, unnest(range(0, {hashes})) AS i FROM (SELECT DISTINCT user_id::VARCHAR AS h FROM events))"""


@query(
    "selector_statistics",
    f"""WITH {EV}, {MEMORY}, s AS (SELECT max(rn) AS steps FROM ev),
    r AS (SELECT list(value ORDER BY event_id) AS v FROM (SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 10)),
    bits AS ({_bits_sql(10000)})
    SELECT steps AS training_step, round(0.3::DOUBLE * pow(0.995::DOUBLE, steps), 6) AS epsilon,
      round(least((SELECT count(*) FROM latest), 10000) / 10000, 6) AS cache_utilization,
      round((SELECT avg((NOT ever)::INT) FROM latest), 6) AS exploration_potential,
      round((SELECT avg(staleness) FROM latest), 6) AS average_staleness,
      {checksum_sql("v")} AS recent_rewards, bits_set AS bloom_filter_size FROM s, r, bits""",
)
def selector_statistics(spark, folder):
    """Users are the cached samples, the newest event values the rewards; the cache of the feature holds 10,000 entries."""
    df = events(spark, folder)
    mem = materialise(memory(spark, folder).select("user_id", "step", "volatility", "staleness", "ever_selected"))
    rewards = select.top_k(df.select("event_id", "value"), "event_id", "event_id", 10).agg(
        F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("r")
    )
    bits, hashes = dedup.filter_size(10_000)
    users = mem.select(F.col("user_id").cast("string").alias("h")).distinct()
    set_bits = dedup.build_filter(users, "h", bits, hashes).agg(F.count("*"))
    steps = mem.agg((F.max("step") + 1).alias("training_step"), F.countDistinct("user_id").alias("samples"))
    stats = history.memory_stats(mem, "user_id").select(F.struct("exploration_potential", "average_staleness")).scalar()
    return steps.withColumn("s", stats).withColumn("r", rewards.select("r.value").scalar()).select(
        "training_step",
        F.round(0.3 * F.pow(F.lit(0.995), "training_step"), 6).alias("epsilon"),
        F.round(F.least("samples", F.lit(10_000)) / 10_000, 6).alias("cache_utilization"),
        F.round("s.exploration_potential", 6).alias("exploration_potential"),
        F.round("s.average_staleness", 6).alias("average_staleness"),
        checksum(F.col("r")).alias("recent_rewards"),
        set_bits.scalar().alias("bloom_filter_size"),
    )


@query(
    "selection_coverage",
    """WITH p AS (SELECT user_id, day(ts) AS round FROM events WHERE event_type = 'purchase'),
    f AS (SELECT user_id, min(round) AS round FROM p GROUP BY user_id),
    n AS (SELECT round, count(*) AS new_samples FROM f GROUP BY round)
    SELECT round, count(*) AS picks, coalesce(any_value(new_samples), 0)::BIGINT AS new_samples,
      round((sum(coalesce(any_value(new_samples), 0)) OVER (ORDER BY round))::DOUBLE / (SELECT count(DISTINCT user_id) FROM events), 6) AS coverage
    FROM p LEFT JOIN n USING (round) GROUP BY round""",
)
def selection_coverage(spark, folder):
    """Purchases of a day of the month are the picks of a round."""
    df = events(spark, folder)
    picks = df.filter("event_type = 'purchase'").select("user_id", F.dayofmonth("ts").cast("long").alias("round"))
    total = df.agg(F.countDistinct("user_id")).scalar()
    return _round(history.selection_coverage(picks, "user_id", "round", total), ["coverage"])


@query(
    "gradient_variance",
    f"""WITH {EV} SELECT event_id, round(CASE WHEN rn > 1 THEN (var_samp(value / 7) OVER {last(10)}
      + var_samp(k / 7) OVER {last(10)} + var_samp((event_id % 17) / 7) OVER {last(10)}) / 3 ELSE 0 END, 4) AS gradient_variance FROM ev""",
)
def gradient_variance(spark, folder):
    grads = F.array(F.col("value") / 7, F.col("k") / 7, F.col("event_id") % 17 / 7)
    df = events(spark, folder).select("user_id", "ts", "event_id", grads.alias("grads"))
    return _round(
        history.gradient_variance(df, *KEY).select("event_id", "gradient_variance"), ["gradient_variance"], 4
    )


def grad_sql(values: str) -> str:
    return f"""(CASE WHEN len({values}) > 1 THEN list_transform(range(1, len({values}) + 1), lambda i:
      CASE WHEN i = 1 THEN {values}[2] - {values}[1] WHEN i = len({values}) THEN {values}[i] - {values}[i - 1]
      ELSE ({values}[i + 1] - {values}[i - 1]) / 2 END) ELSE [0.0::DOUBLE] END)"""


@query(
    "trajectory_features",
    f"""WITH {EV}, t AS (SELECT *, list(value) OVER {last(50)} AS v FROM ev)
    SELECT event_id, round(list_avg(v), 9) AS mean, round(list_aggregate(v, 'stddev_pop'), 9) AS std, value AS current,
      round(list_avg({grad_sql("v")}), 9) AS trend, round(list_max(v) - list_min(v), 9) AS range FROM t""",
)
def trajectory_features(spark, folder):
    df = events(spark, folder).select("user_id", "ts", "event_id", "value")
    found = history.trajectory(df, *KEY, "value").select("event_id", "mean", "std", "current", "trend", "range")
    # frames of 16 or 32 values end in ties at the seventh decimal, none beyond the eighth
    return _round(found, ["mean", "std", "trend", "range"], 9)


# --- state vectors ----------------------------------------------------------------------


SERIES = """
ser AS (
  SELECT user_id, event_id, rn, value / 100 AS loss, k / 100 AS train_accuracy, k / 120 AS val_accuracy,
    value / 50 AS gradient_norm, ln(1 + k) AS selection_entropy,
    CASE WHEN event_type = 'error' THEN 0.001::DOUBLE / (1 + k) END AS learning_rate,
    CASE WHEN event_type = 'click' THEN value / 10 END AS reward_grad_mag, CASE WHEN event_type = 'click' THEN 0.4::DOUBLE END AS usage_grad_mag,
    CASE WHEN event_type = 'view' THEN value / 10 END AS reward_diversity, CASE WHEN event_type = 'view' THEN 0.3::DOUBLE END AS usage_diversity,
    CASE WHEN event_type = 'signup' THEN value / 10 END AS reward_uncertainty, CASE WHEN event_type = 'signup' THEN 0.2::DOUBLE END AS usage_uncertainty
  FROM ev)
"""


def _run_series(spark, folder) -> DataFrame:
    logs = {"grad_mag": ("click", 0.4), "diversity": ("view", 0.3), "uncertainty": ("signup", 0.2)}
    columns = []
    for name in history.STATE_STRATEGIES:
        kind, usage = logs.get(name, (None, None))
        hit = F.col("event_type") == F.lit(kind)
        columns.append(F.when(hit, F.col("value") / 10).alias(f"reward_{name}"))
        columns.append(F.when(hit, F.lit(usage).cast("double")).alias(f"usage_{name}"))
    return events(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("value") / 100).alias("loss"), (F.col("k") / 100).alias("train_accuracy"),
        (F.col("k") / 120).alias("val_accuracy"), (F.col("value") / 50).alias("gradient_norm"),
        F.log(F.col("k") + 1).alias("selection_entropy"),
        F.when(F.col("event_type") == "error", 0.001 / (1 + F.col("k"))).alias("learning_rate"),
        *columns,
    )


def _traj_sql(c: str) -> str:
    v = f"l_{c}"
    return f"list_avg({v}), list_aggregate({v}, 'stddev_pop'), {v}[len({v})], list_avg({grad_sql(v)}), list_max({v}) - list_min({v})"


_TRAJ = ("loss", "train_accuracy", "val_accuracy", "gradient_norm", "selection_entropy")
_LISTS = ", ".join(f"list({c}) OVER {last(50)} AS l_{c}" for c in _TRAJ)
_RU = ", ".join(
    f"coalesce(avg(reward_{s}) OVER {last(50)}, 0) AS ar_{s}, coalesce(avg(usage_{s}) OVER {last(50)}, 0) AS au_{s}"
    for s in ("grad_mag", "diversity", "uncertainty")
)


@query(
    "run_state_vector",
    f"""WITH {EV}, {SERIES}, t AS (
      SELECT *, {_LISTS}, {_RU}, coalesce(last_value(learning_rate IGNORE NULLS) OVER {last(50)}, 0.001::DOUBLE) AS lr FROM ser),
    s AS (SELECT event_id, list_concat([{", ".join(_traj_sql(c) for c in _TRAJ[:4])}, lr, {_traj_sql("selection_entropy")},
      ar_grad_mag, au_grad_mag, ar_diversity, au_diversity, ar_uncertainty, au_uncertainty, 0, 0, 0, 0],
      [greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - loss / (l_loss[1] + 1e-8)))]) AS state FROM t)
    SELECT event_id, len(state) AS size, {checksum_sql("state")} AS checksum FROM s""",
)
def run_state_vector(spark, folder):
    found = history.run_state_vector(_run_series(spark, folder), *KEY)
    return found.select("event_id", F.size("state").cast("long").alias("size"), checksum(F.col("state")).alias("checksum"))


TREND = f"""
tr AS (
  SELECT *, value / 100 AS v, lag(value / 100, 4) OVER {W()} AS p4, lag(value / 100, 2) OVER {W()} AS p2 FROM ev),
trends AS (
  SELECT *, coalesce((v - p4) / (abs(p4) + 1e-8), 0) AS trend5, coalesce((v - p2) / 3, 0) AS trend3_mean,
    coalesce((v - p2) / (abs(p2) + 1e-8), 0) AS trend3_relative FROM tr)
"""


@query(
    "perf_trend",
    f"""WITH {EV}, {TREND} SELECT event_id, round(trend5, 4) AS trend5, round(trend3_mean, 6) AS trend3_mean,
    round(trend3_relative, 4) AS trend3_relative FROM trends""",
)
def perf_trend(spark, folder):
    df = events(spark, folder).withColumn("v", F.col("value") / 100)
    found = history.perf_trend(df, *KEY, "v").select("event_id", "trend5", "trend3_mean", "trend3_relative")
    return _round(_round(found, ["trend5", "trend3_relative"], 4), ["trend3_mean"])


# Run metrics derived from an event, in Spark and SQL syntax alike; r is the step from 1.
_METRICS = {
    "epoch": "r - 1", "loss": "value / 100", "val_loss": "value / 80", "accuracy": "k / 100",
    "perplexity": "1 + value / 10", "learning_rate": "1 / (1000.0 * (1 + r % 7))", "gradient_norm": "value / 50",
    "seen_ratio": "k / 200", "diversity": "k / 100", "tokens_seen": "r * 100", "total_tokens": "20000",
    "memory": "k / 100", "compute": "k / 120", "violations": "k % 3", "checks": "k % 5",
    "memory_budget": "4 / 5", "compute_budget": "9 / 10", "mean_quality": "k / 99", "avg_length": "k * 5",
    "vocab_coverage": "k / 101", "attention_entropy": "k / 102",
    **{f"share_{d}": f"((k + {i}) % 4) / 6" for i, d in enumerate(analytics.DOMAINS)},
    **{f"share_{d}": f"((k + {i}) % 3) / 3" for i, d in enumerate(analytics.LENGTHS)},
}
_METRIC_SQL = ", ".join(f"({e.replace('1000.0', '1000')})::DOUBLE AS {n}" for n, e in _METRICS.items())
_SHARES = ", ".join(f"share_{n}" for n in (*analytics.DOMAINS, *analytics.LENGTHS))
_CLASSES = ", ".join(f"((k + {i}) % 10) / 45" for i in range(10))
_HEAD = "ln(perplexity + 1e-8), log10(learning_rate + 1e-10), tokens_seen / greatest(total_tokens, 1)"


@query(
    "state_features",
    f"""WITH {EV}, {TREND}, m AS (SELECT *, {_METRIC_SQL} FROM (SELECT *, rn AS r FROM trends)),
    h AS (SELECT *, list(v) OVER {last(5)} AS h5 FROM m),
    s AS (SELECT event_id,
      [epoch / 1000, loss, accuracy, gradient_norm, log10(learning_rate + 1e-10), seen_ratio, diversity, {_CLASSES}, trend3_relative, 0] AS image,
      [epoch / 1000, loss, val_loss, {_HEAD}, gradient_norm, diversity, memory, {_SHARES}, trend3_mean] AS document,
      list_concat([epoch / 100, ln(loss + 1e-8), ln(perplexity + 1e-8) / 10, ln(gradient_norm + 1e-8), log10(learning_rate + 1e-10),
        tokens_seen / total_tokens, avg_length / 512, vocab_coverage, attention_entropy],
        CASE WHEN rn >= 5 THEN list_append(h5, trend5) ELSE [0.0, 0.0, 0.0, 0.0, 0.0, 0.0] END) AS token,
      [epoch / 1000, loss, val_loss, {_HEAD}, gradient_norm, memory, compute, diversity, violations / greatest(checks, 1),
        {_SHARES}, trend3_mean, memory / memory_budget, compute / compute_budget, mean_quality] AS environment
      FROM h)
    SELECT event_id, len(image) AS n_image, len(document) AS n_document, len(token) AS n_token, len(environment) AS n_environment,
      {", ".join(f"{checksum_sql(n)} AS {n}" for n in ("image", "document", "token", "environment"))} FROM s""",
)
def state_features(spark, folder):
    """All four forms of the run state, compared by size and checksum."""
    def build(d, w):
        d = history.trend_columns(d, w, "v")
        recent = [F.coalesce(F.lag("v", 4 - i).over(w), F.lit(0.0)) for i in range(5)]
        full = F.col("_rank") >= 5
        for i, c in enumerate(recent):
            d = d.withColumn(f"_h{i}", F.when(full, c).otherwise(0.0))
        return d

    df = events(spark, folder).withColumn("v", F.col("value") / 100)
    d = over_history(df, *KEY, 4, build).withColumn("r", F.col("_rank"))
    d = d.select(
        "event_id", "k", "trend5", "trend3_mean", "trend3_relative", *[f"_h{i}" for i in range(5)],
        *[F.expr(e).cast("double").alias(n) for n, e in _METRICS.items()],
    )
    classes = [((F.col("k") + i) % 10) / 45 for i in range(10)]
    forms = {
        "image": analytics.image_state(classes, F.col("trend3_relative")),
        "document": analytics.document_state(F.col("trend3_mean")),
        "token": analytics.token_state([F.col(f"_h{i}") for i in range(5)], F.col("trend5")),
        "environment": analytics.environment_state(F.col("trend3_mean")),
    }
    staged = d.select("event_id", *[c.alias(n) for n, c in forms.items()])
    return staged.select(
        "event_id", *[F.size(n).cast("long").alias(f"n_{n}") for n in forms], *[checksum(F.col(n)).alias(n) for n in forms]
    )


# --- phases -------------------------------------------------------------------------------


STEPS = """
steps AS (
  SELECT user_id, event_id, rn, value / 50 AS norm, cos(k / 25) AS alignment, value / 100 AS loss, ln(1 + k) AS entropy FROM ev)
"""


def steps(spark, folder) -> DataFrame:
    return events(spark, folder).select(
        "user_id", "ts", "event_id", (F.col("value") / 50).alias("norm"), F.cos(F.col("k") / 25).alias("alignment"),
        (F.col("value") / 100).alias("loss"), F.log(F.col("k") + 1).alias("entropy"),
    )


def _at(k: int) -> str:
    return f"lag(loss, {k}) OVER {W()}"


CURVE = f"""
curve AS (
  SELECT *, CASE WHEN rn - 1 >= 3 THEN abs({_at(1)} - 2 * {_at(2)} + {_at(3)})
    WHEN rn - 1 = 2 THEN abs({_at(1)} - {_at(2)}) ELSE 0 END AS curvature FROM steps)
"""


@query("curvature", f"WITH {EV}, {STEPS}, {CURVE} SELECT event_id, round(curvature, 6) AS curvature FROM curve")
def curvature(spark, folder):
    return _round(phases.curvature(steps(spark, folder), *KEY).select("event_id", "curvature"), ["curvature"])


def _jump_sql(v: str) -> str:
    return f"(abs({v}[len({v})]) / (list_aggregate({v}, 'stddev_pop') + 1e-8))"


INDICATORS = f"""
ind0 AS (
  SELECT *, list(norm) OVER {last(50)} AS ln_, list(entropy) OVER {last(50)} AS le_,
    avg(alignment) OVER {last(5)} AS a5, avg(curvature) OVER {last(5)} AS c5,
    avg(curvature) OVER {W("ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING")} AS c10,
    var_pop(loss) OVER {last(10)} AS rv,
    CASE WHEN rn >= 20 THEN var_pop(loss) OVER {W("ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING")} ELSE var_pop(loss) OVER {last(10)} END AS pv
  FROM curve),
ind1 AS (SELECT *, {grad_sql("ln_")} AS gn, {grad_sql("le_")} AS ge FROM ind0),
ind AS (
  SELECT user_id, event_id, rn, norm, alignment, loss, entropy,
    CASE WHEN rn >= 5 THEN {_jump_sql("gn")} ELSE 0 END AS norm_change,
    CASE WHEN rn >= 5 THEN greatest(0.0::DOUBLE, a5 - alignment) ELSE 0 END AS alignment_drop,
    CASE WHEN rn >= 10 THEN abs(c5 - c10) / (c10 + 1e-8) ELSE 0 END AS curvature_shift,
    CASE WHEN rn >= 5 THEN {_jump_sql("ge")} ELSE 0 END AS entropy_change,
    CASE WHEN rn >= 5 THEN abs(rv - pv) / (pv + 1e-8) ELSE 0 END AS landscape_shift
  FROM ind1),
scored AS (
  SELECT *, 0.3::DOUBLE * norm_change + 0.25::DOUBLE * alignment_drop + 0.2::DOUBLE * curvature_shift
    + 0.15::DOUBLE * entropy_change + 0.1::DOUBLE * landscape_shift AS score FROM ind),
det AS (SELECT *, avg(score) OVER {last(5)} AS score_mean, rn >= 10 AND avg(score) OVER {last(5)} > 2.0 AS is_transition FROM scored)
"""
PHASES = f"{EV}, {STEPS}, {CURVE}, {INDICATORS}"
_NAMES = ("norm_change", "alignment_drop", "curvature_shift", "entropy_change", "landscape_shift")


@query(
    "transition_indicators",
    f"WITH {PHASES} SELECT event_id, {', '.join(f'round({n}, 4) AS {n}' for n in _NAMES)} FROM ind",
)
def transition_indicators(spark, folder):
    found = phases.transition_indicators(steps(spark, folder), *KEY).select("event_id", *_NAMES)
    return _round(found, _NAMES, 4)


@query("transition_score", f"WITH {PHASES} SELECT event_id, round(score, 4) AS score FROM scored")
def transition_score(spark, folder):
    found = phases.transition_indicators(steps(spark, folder), *KEY)
    return found.select("event_id", F.round(phases.transition_score(), 4).alias("score"))


@query(
    "phase_detect",
    f"""WITH {PHASES} SELECT event_id, is_transition,
    round(CASE WHEN is_transition THEN least(score_mean / 4, 1.0::DOUBLE) ELSE 0 END, 4) AS confidence FROM det""",
)
def phase_detect(spark, folder):
    found = phases.detect_phases(steps(spark, folder), *KEY)
    return _round(found.select("event_id", "is_transition", "confidence"), ["confidence"], 4)


SEGMENTS = f"""
looks AS (
  SELECT *, avg(norm) OVER {last(50)} AS avg_gradient_norm, avg(alignment) OVER {last(50)} AS gradient_stability,
    var_pop(loss) OVER {last(50)} AS loss_variance, avg(entropy) OVER {last(50)} AS selection_diversity,
    CASE WHEN curvature_shift > 2.0 THEN 'chaotic' WHEN landscape_shift < 0.1 THEN 'plateau'
      WHEN norm_change > 3.0 THEN 'steep' ELSE 'converging' END AS landscape FROM det),
seg0 AS (
  SELECT user_id, rn - 1 AS start_epoch, landscape, avg_gradient_norm, gradient_stability, loss_variance, selection_diversity,
    CASE landscape WHEN 'chaotic' THEN 'diversity' WHEN 'plateau' THEN 'uncertainty' WHEN 'steep' THEN 'gradient_magnitude' ELSE 'hybrid' END AS strategy
  FROM looks WHERE is_transition
  UNION ALL SELECT DISTINCT user_id, 0, 'chaotic', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'uncertainty' FROM events),
seg AS (SELECT *, lead(start_epoch) OVER (PARTITION BY user_id ORDER BY start_epoch) AS end_epoch FROM seg0)
"""
_FACTS = ("avg_gradient_norm", "gradient_stability", "loss_variance", "selection_diversity")


@query(
    "phase_segments",
    f"""WITH {PHASES}, {SEGMENTS} SELECT user_id, start_epoch, end_epoch, landscape, strategy,
    {', '.join(f'round({n}, 10) AS {n}' for n in _FACTS)} FROM seg""",
)
def phase_segments(spark, folder):
    found = phases.phase_segments(steps(spark, folder), *KEY)
    return _round(found.select("user_id", "start_epoch", "end_epoch", "landscape", "strategy", *_FACTS), _FACTS, 10)


@query(
    "phase_summary",
    f"""WITH {PHASES}, {SEGMENTS} SELECT user_id, count(end_epoch) AS num_transitions,
    round(coalesce(avg(end_epoch - start_epoch), 0), 6) AS avg_phase_length FROM seg GROUP BY user_id""",
)
def phase_summary(spark, folder):
    segments = phases.phase_segments(steps(spark, folder), *KEY)
    return _round(phases.phase_summary(segments, ["user_id"]), ["avg_phase_length"])


@query(
    "phase_label",
    f"""WITH {EV}, {STEPS}, l AS (SELECT *, var_pop(loss / 10) OVER {last(10)} AS v, avg(norm / 4) OVER {last(10)} AS n FROM steps)
    SELECT event_id, CASE WHEN rn < 10 THEN 'early' WHEN v > 0.1 OR n > 1.0 THEN 'early' WHEN v < 0.01 AND n < 0.1 THEN 'late'
      WHEN abs(alignment) > 0.8 THEN 'transition' ELSE 'middle' END AS phase FROM l""",
)
def phase_label(spark, folder):
    df = steps(spark, folder).withColumns({"loss": F.col("loss") / 10, "norm": F.col("norm") / 4})
    return phases.phase_label(df, *KEY).select("event_id", "phase")


@query(
    "grad_alignment_ema",
    f"""WITH RECURSIVE {EV}, g AS (SELECT user_id, event_id, rn, [value / 50, cos(k / 25), 1.0::DOUBLE] AS g FROM ev),
    walk AS (
      SELECT user_id, event_id, rn, g, g AS m, 1.0::DOUBLE AS alignment FROM g WHERE rn = 1
      UNION ALL
      SELECT n.user_id, n.event_id, n.rn, n.g,
        CASE WHEN n.rn = 2 THEN n.g ELSE [0.9::DOUBLE * w.m[1] + 0.1::DOUBLE * n.g[1], 0.9::DOUBLE * w.m[2] + 0.1::DOUBLE * n.g[2],
          0.9::DOUBLE * w.m[3] + 0.1::DOUBLE * n.g[3]] END,
        CASE WHEN n.rn = 2 THEN 1.0::DOUBLE ELSE list_cosine_similarity(n.g, w.m) END
      FROM walk w JOIN g n ON n.user_id = w.user_id AND n.rn = w.rn + 1)
    SELECT event_id, round(alignment, 6) AS alignment FROM walk""",
)
def grad_alignment_ema(spark, folder):
    grad = F.array(F.col("value") / 50, F.cos(F.col("k") / 25), F.lit(1.0))
    df = events(spark, folder).select("user_id", "ts", "event_id", grad.alias("grad"))
    return _round(phases.alignment_ema(df, *KEY).select("event_id", "alignment"), ["alignment"])


@query(
    "rl_state_onehot",
    f"""WITH {PHASES}, {SEGMENTS}, p AS (SELECT *, lag(loss, 4) OVER {W()} AS past FROM looks),
    cur AS (
      SELECT p.*, s.landscape AS phase_type, p.rn - 1 - s.start_epoch AS in_phase,
        coalesce((loss - past) / (abs(past) + 1e-8), 0) AS trend FROM p JOIN seg s ON s.user_id = p.user_id
        AND p.rn - 1 >= s.start_epoch AND (s.end_epoch IS NULL OR p.rn - 1 < s.end_epoch)),
    rew AS (SELECT user_id, {", ".join(f"avg(value / 10) FILTER (WHERE event_type = '{e}') AS r_{e}" for e in ("click", "error", "purchase", "signup", "view"))} FROM events GROUP BY user_id),
    st AS (SELECT event_id, [norm_change, alignment_drop, curvature_shift, entropy_change, landscape_shift,
      (phase_type = 'chaotic')::INT, (phase_type = 'plateau')::INT, (phase_type = 'steep')::INT, (phase_type = 'converging')::INT,
      in_phase / 100, trend, 0.5, rn / 1000, coalesce(r_click, 0), coalesce(r_error, 0), coalesce(r_purchase, 0), coalesce(r_signup, 0),
      coalesce(r_view, 0)] AS state FROM cur JOIN rew USING (user_id))
    SELECT event_id, len(state) AS size, round(list_sum(list_transform(state, lambda v, i: v * i)), 3) AS checksum FROM st""",
)
def rl_state_onehot(spark, folder):
    """The five event types are the strategies; their mean values are the rewards.

    A step belongs to the last phase that started at or before it, found by
    carrying the latest start along the history.
    """
    def first_pass(d, w):
        d = phases.detection_columns(phases.indicator_columns(d, w), w)
        past = F.lag("loss", 4).over(w)
        return d.withColumn("performance_trend", F.coalesce((F.col("loss") - past) / (F.abs(past) + 1e-8), F.lit(0.0)))

    detected = materialise(
        over_history(steps(spark, folder), *KEY, phases.BACK, first_pass).withColumn("step", F.col("_rank") - 1).drop("_rank")
    )
    start = F.when(F.col("is_transition"), F.struct("step", phases.landscape().alias("landscape")))

    def second_pass(d, w):
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = F.greatest(F.max(start).over(upto), F.col("_phase"))
        return d.withColumn("_now", found)

    carry = {"_phase": Carry(F.max(start), "struct<step:bigint,landscape:string>", F.max)}
    placed = over_history(detected, ["user_id"], "step", "event_id", 0, second_pass, carry)
    kinds = ("click", "error", "purchase", "signup", "view")
    rewards = events(spark, folder).groupBy("user_id").agg(
        *[F.coalesce(F.avg(F.when(F.col("event_type") == e, F.col("value") / 10)), F.lit(0.0)).alias(f"r_{e}") for e in kinds]
    )
    d = placed.join(rewards, "user_id").select(
        "event_id", *_NAMES, "performance_trend", *[f"r_{e}" for e in kinds],
        F.coalesce("_now.landscape", F.lit("chaotic")).alias("landscape"),
        (F.col("step") - F.coalesce("_now.step", F.lit(0))).alias("epochs_in_phase"),
        F.lit(0.5).alias("memory_usage"), ((F.col("step") + 1) / 1000).alias("compute_used"),
    )
    state = analytics.phase_state([F.col(f"r_{e}") for e in kinds])
    staged = d.select("event_id", state.alias("state"))
    return staged.select(
        "event_id", F.size("state").cast("long").alias("size"),
        F.round(V.total(F.transform("state", lambda v, i: v * (i + 1))), 3).alias("checksum"),
    )


# --- combining ------------------------------------------------------------------------------


@query(
    "zscore_sigmoid",
    f"""WITH {EV}, z AS (
      SELECT event_id, rn, value, avg(value) OVER {W("ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING")} AS m,
        stddev_pop(value) OVER {W("ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING")} AS s FROM ev)
    SELECT event_id, round(1 / (1 + exp(-(CASE WHEN rn > 11 THEN (value - m) / (s + 1e-8) ELSE value END))), 6) AS score FROM z""",
)
def zscore_sigmoid(spark, folder):
    df = events(spark, folder).select("user_id", "ts", "event_id", "value")
    return _round(combine.zscore_sigmoid(df, *KEY, "value", "score").select("event_id", "score"), ["score"])


@query(
    "reward_ema_weights",
    """WITH r AS (SELECT event_type AS strategy, value / 1000 AS r,
      row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events),
    e AS (SELECT strategy, sum(0.1::DOUBLE * pow(0.9::DOUBLE, age) * r) AS ema FROM r WHERE age < 50 GROUP BY strategy)
    SELECT strategy, round(ema, 6) AS ema, round(exp(ema * 10) / sum(exp(ema * 10)) OVER (), 6) AS weight FROM e""",
)
def reward_ema_weights(spark, folder):
    df = events(spark, folder).select(
        F.col("event_type").alias("strategy"), "ts", "event_id", (F.col("value") / 1000).alias("reward")
    )
    return _round(combine.reward_weights(df, "strategy", "ts", "event_id", "reward"), ["ema", "weight"])


@query(
    "strategy_reward_pick",
    """WITH r AS (SELECT event_type AS strategy, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events),
    m AS (SELECT strategy, avg(value) AS mean_reward FROM r WHERE age <= 100 GROUP BY strategy)
    SELECT strategy, round(mean_reward, 6) AS mean_reward, row_number() OVER (ORDER BY m.mean_reward DESC, strategy) AS place FROM m""",
)
def strategy_reward_pick(spark, folder):
    df = events(spark, folder).select(F.col("event_type").alias("strategy"), "ts", "event_id", "value")
    return _round(analytics.strategy_reward_pick(df, "strategy", "ts", "event_id", "value"), ["mean_reward"])


@query(
    "strategy_explore",
    """WITH b AS (SELECT event_type AS best FROM events GROUP BY event_type ORDER BY avg(value) DESC, event_type LIMIT 1),
    u AS (SELECT event_id, ('0x' || substr(md5('0:explore:' || event_id), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS e,
      ('0x' || substr(md5('0:arm:' || event_id), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS a FROM events)
    SELECT event_id, CASE WHEN e < 0.1 THEN (['click', 'error', 'purchase', 'signup', 'view'])[floor(a * 5)::INT + 1] ELSE best END AS strategy
    FROM u, b""",
)
def strategy_explore(spark, folder):
    """The best strategy of the rounds, or with probability 0.1 any other."""
    df = events(spark, folder)
    means = df.groupBy("event_type").agg(F.avg("value").alias("m")).orderBy(F.col("m").desc(), "event_type").limit(1)
    best = means.select("event_type").scalar()
    names = ["click", "error", "purchase", "signup", "view"]
    return df.select("event_id", analytics.explore(df, F.col("event_id"), names, best, 0.1).alias("strategy"))


@query(
    "submodular_check",
    f"""WITH {EV}, l AS (SELECT *, min(value) OVER {W("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")} AS low FROM ev)
    SELECT count(low) AS checks, count(*) FILTER (WHERE low < value - 1e-6) AS violations,
      round(count(*) FILTER (WHERE low < value - 1e-6) / count(low), 6) AS violation_rate FROM l""",
)
def submodular_check(spark, folder):
    """A user's values in time order as gains on growing sets."""
    df = events(spark, folder).select("user_id", "ts", "event_id", "value")
    return _round(greedy.submodular_check(df, "user_id", "ts", "event_id", "value"), ["violation_rate"])


@query(
    "constraint_check",
    f"""WITH {EV}, c AS (SELECT abs(value / 100 - (value + k / 20) / 100) AS e, k * 20 AS n FROM ev)
    SELECT round(avg(e), 6) AS avg_epsilon, round(max(e), 6) AS max_epsilon, round(avg((e <= 0.045)::INT), 6) AS satisfaction_rate,
      round(avg((n <= 1000)::INT), 6) AS size_ok_rate, count(*) AS total_checks FROM c""",
)
def constraint_check(spark, folder):
    """Checks with a gap of 0.045 that no pair meets exactly."""
    df = events(spark, folder).select(
        (F.col("value") / 100).alias("loss_full"), ((F.col("value") + F.col("k") / 20) / 100).alias("loss_coreset"),
        (F.col("k") * 20).alias("size"),
    )
    found = select.check_constraint(df, F.col("size"), max_gap=0.045)
    return _round(found, ["avg_epsilon", "max_epsilon", "satisfaction_rate", "size_ok_rate"])


@query(
    "selection_entropy",
    """WITH c AS (SELECT count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM (SELECT n / sum(n) OVER () AS p FROM c)""",
)
def selection_entropy(spark, folder):
    return _round(metrics.frequency_entropy(events(spark, folder).filter("event_type = 'purchase'"), "user_id"), ["entropy"])


@query(
    "loss_std",
    f"""WITH {EV} SELECT user_id, round(avg(value / 100), 6) AS avg_loss, round(exp(avg(value / 100)), 6) AS avg_perplexity,
    round(stddev_pop(value / 100), 6) AS loss_std, sum(k)::BIGINT AS total_tokens FROM ev GROUP BY user_id""",
)
def loss_std(spark, folder):
    df = events(spark, folder).select("user_id", (F.col("value") / 100).alias("loss"), "k")
    return _round(metrics.loss_summary(df, ["user_id"], "loss", "k"), ["avg_loss", "avg_perplexity", "loss_std"])


@query("fifo_cache", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 500")
def fifo_cache(spark, folder):
    """The 500 newest events."""
    df = events(spark, folder)
    aged = df.select("event_id", numeric_order(df, "ts").alias("age"))
    return dedup.newest(aged, "age", "event_id", 500).select("event_id")


@query(
    "cache_evict",
    """WITH n AS (SELECT count(*) AS c FROM events)
    SELECT event_id FROM events, n QUALIFY row_number() OVER (ORDER BY event_id DESC) <= c - floor(c * 0.2::DOUBLE)""",
)
def cache_evict(spark, folder):
    """The oldest fifth leaves a cache that holds more than 900 entries."""
    df = events(spark, folder).select("event_id")
    return dedup.evict(df, "event_id", "event_id", 900)
