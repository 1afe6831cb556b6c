"""Reports on runs, timers, strategies and trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.combine import PHASE_SCORES
from gleaner.scale import exact_percentiles, group_rank, over_history
from gleaner.scale.frames import Carry
from gleaner.session import materialise

# Advice per kind of timer.
ADVICE = {
    "coreset_selection": "Consider optimizing coreset selection algorithm or reducing selection frequency",
    "evaluation": "Consider reducing evaluation frequency or using smaller validation sets",
    "training": "Consider optimizing batch size or model architecture",
    "svd": "SVD operations are expensive - consider reducing rank or using approximations",
}


# --- timers, memory, counters -------------------------------------------------


def timing_stats(df: DataFrame, name: str, seconds: str, **kw) -> DataFrame:
    """Count, total, mean, spread, extremes and exact median per timer."""
    stats = df.groupBy(name).agg(
        F.count("*").alias("calls"),
        F.sum(seconds).alias("total"),
        F.avg(seconds).alias("mean"),
        F.stddev_pop(seconds).alias("std"),
        F.min(seconds).alias("min"),
        F.max(seconds).alias("max"),
    )
    return stats.join(exact_percentiles(df, [name], seconds, 0.5, "median", **kw), name)


def bottlenecks(df: DataFrame, name: str, seconds: str, share: float = 10.0) -> DataFrame:
    """Timers with more than `share` percent of the time, and what to do about them."""
    stats = df.groupBy(name).agg(
        F.sum(seconds).alias("total"), F.avg(seconds).alias("avg_time"), F.count("*").alias("call_count")
    )
    percentage = F.col("total") / stats.agg(F.sum("total")).scalar() * 100
    label = F.col(name)
    advice = F.when(F.lit(False), "")
    for word, text in ADVICE.items():
        advice = advice.when(F.contains(F.lower(label) if word == "svd" else label, F.lit(word)), text)
    return (
        stats.withColumn("percentage", percentage)
        .filter(F.col("percentage") > share)
        .withColumn("recommendation", advice)
    )


def memory_latest(df: DataFrame, name: str, ts: str, ident: str, allocated: str, reserved: str) -> DataFrame:
    newest = F.max_by(F.struct(F.col(allocated).alias("a"), F.col(reserved).alias("r")), F.struct(ts, ident))
    return df.groupBy(name).agg(newest.alias("m")).select(
        name, F.col("m.a").alias("allocated"), F.col("m.r").alias("reserved")
    )


def counters(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.groupBy(name).agg(F.sum(value).alias("value"))


# --- runs -----------------------------------------------------------------------


def run_rollup(df: DataFrame, run: str, epoch: str, accuracy: str, loss: str, transition: str, strategy: str) -> DataFrame:
    """Final and best accuracy, final loss, transitions and the strategies used, per run."""
    return df.groupBy(run).agg(
        F.max_by(accuracy, epoch).alias("final_accuracy"),
        F.max(accuracy).alias("best_accuracy"),
        F.max_by(loss, epoch).alias("final_loss"),
        F.count_if(transition).alias("num_transitions"),
        F.array_join(F.array_sort(F.collect_set(strategy)), ",").alias("strategies"),
    )


def reward_delta(df: DataFrame, keys: Sequence[str], order: str, ident: str, **kw) -> DataFrame:
    """All reward forms, from accuracy, loss, perplexity, downstream and efficiency against the step before."""

    def build(d, w):
        def before(c: str) -> Column:
            return F.lag(c).over(w)

        accuracy = F.col("accuracy") - before("accuracy")
        loss = before("loss") - F.col("loss")
        ppl = before("perplexity") - F.col("perplexity")
        relative_ppl = ppl / (before("perplexity") + 1e-8)
        relative_loss = loss / (before("loss") + 1e-8)
        delta = 0.5 * relative_ppl + 0.5 * relative_loss
        return (
            d.withColumn("reward_accuracy", accuracy)
            .withColumn("reward_mixed", 0.7 * accuracy + 0.3 * loss)
            .withColumn("reward_relative", delta)
            .withColumn("reward_feedback", delta + 0.5 * relative_ppl)
            .withColumn(
                "reward_objectives",
                0.4 * ppl + 0.3 * loss + 0.2 * F.col("downstream") + 0.1 * F.col("efficiency"),
            )
        )

    return over_history(df, keys, order, ident, 1, build, **kw)


def reward_by_weight(df: DataFrame, weights: dict[str, float], keys, order, ident, accuracy: str, **kw) -> DataFrame:
    """(…, strategy, reward, usage): the accuracy gain split by strategy weight, from the second step on."""
    pairs = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(v).alias("usage")) for k, v in weights.items()])

    def build(d, w):
        return d.withColumn("_gain", F.col(accuracy) - F.lag(accuracy).over(w))

    return (
        over_history(df, keys, order, ident, 1, build, **kw)
        .filter(F.col("_rank") > 1)
        .select(*keys, ident, "_gain", F.inline(pairs))
        .select(*keys, ident, "strategy", (F.col("_gain") * F.col("usage")).alias("reward"), "usage")
    )


def env_reward(df: DataFrame, keys, order, ident, **kw) -> DataFrame:
    """Adds `reward` over logged steps: gain, thrift, penalties and the diversity bonus."""

    def build(d, w):
        gain = F.coalesce(F.lag("perplexity").over(w) - F.col("perplexity"), F.lit(0.0))
        thrift = 1.0 - F.col("selected") / F.col("budget")
        violations = -0.1 * (F.col("violations") / F.greatest(F.col("checks"), F.lit(1)))

        def excess(used: str, limit: str) -> Column:
            return -0.5 * F.greatest(F.lit(0.0), F.col(used) - F.col(limit))

        bonus = 0.1 * (F.get("weights", F.lit(1)) + F.get("weights", F.lit(2)))
        return d.withColumn(
            "reward",
            10.0 * gain + 2.0 * thrift + violations
            + excess("memory", "memory_budget") + excess("compute", "compute_budget") + bonus,
        )

    return over_history(df, keys, order, ident, 1, build, **kw)


def strategy_usage(df: DataFrame, strategies: str) -> DataFrame:
    """Count per strategy over runs with an array of strategies."""
    return df.select(F.explode(strategies).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("uses"))


def strategy_effect(df: DataFrame, strategy: str, accuracy: str) -> DataFrame:
    return df.groupBy(strategy).agg(F.avg(accuracy).alias("mean_accuracy"), F.count("*").alias("epochs"))


def transitions_per_run(df: DataFrame, run: str, transition: str) -> DataFrame:
    return df.groupBy(run).agg(F.count_if(transition).alias("transitions"))


def transition_histogram(df: DataFrame, run: str, transition: str) -> DataFrame:
    return transitions_per_run(df, run, transition).groupBy("transitions").agg(F.count("*").alias("runs"))


def parse_run_name(df: DataFrame, name: str) -> DataFrame:
    """Splits `<set>_<type>_sev<n>` into dataset, corruption and severity."""
    pattern = r"^([^_]+)_(.+)_sev(\d+)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return (
        df.filter(F.col(name).rlike(pattern))
        .withColumn("dataset", part(1))
        .withColumn("corruption", part(2))
        .withColumn("severity", part(3).cast("int"))
    )


def robustness_pivot(df: DataFrame, name: str, accuracy: str, severities: Sequence[int]) -> DataFrame:
    """Accuracy by corruption and severity; missing runs count as 0."""
    wide = (
        parse_run_name(df, name).groupBy("dataset", "corruption")
        .pivot("severity", list(severities)).agg(F.avg(accuracy))
        .na.fill(0.0)
    )
    columns = [F.col(str(s)).alias(f"sev{s}") for s in severities]
    mean = sum((F.col(str(s)) for s in severities), F.lit(0.0)) / len(severities)
    return wide.select("dataset", "corruption", *columns, mean.alias("mean_accuracy"))


def robustness_cube(df: DataFrame, name: str, accuracy: str) -> DataFrame:
    """Mean accuracy by corruption and severity with all subtotals."""
    return parse_run_name(df, name).cube("corruption", "severity").agg(
        F.avg(accuracy).alias("mean_accuracy"), F.count("*").alias("runs")
    )


def best_run(df: DataFrame, run: str, accuracy: str) -> DataFrame:
    """Run with the highest accuracy; the first name wins ties."""
    return df.orderBy(F.col(accuracy).desc(), run).limit(1).select(run, accuracy)


def improvement_vs_first(df: DataFrame, keys, order, ident, value: str, **kw) -> DataFrame:
    """Adds `improvement` over the run's first value and the running best `best`."""
    def build(d, w):
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.coalesce(F.col("_first"), F.first(value).over(upto))
        return d.withColumn("improvement", F.col(value) - first).withColumn(
            "best", F.greatest(F.max(value).over(upto), F.col("_best"))
        )

    carry = {
        "_first": Carry(F.min_by(value, "_rank"), "double", F.first),
        "_best": Carry(F.max(value), "double", F.max),
    }
    return over_history(df, keys, order, ident, 0, build, carry, **kw)


def config_compare(df: DataFrame, config: str, epoch: str, perplexity: str, selection: str, training: str) -> DataFrame:
    """Best, final and first perplexity, mean times and the improvement if there is one, per configuration."""
    first, final = F.min_by(perplexity, epoch), F.max_by(perplexity, epoch)
    gain = (F.col("first_perplexity") - F.col("final_perplexity")) / F.nullif(F.col("first_perplexity"), F.lit(0))
    return df.groupBy(config).agg(
        F.min(perplexity).alias("best_perplexity"),
        first.alias("first_perplexity"),
        final.alias("final_perplexity"),
        F.avg(selection).alias("avg_selection_time"),
        F.avg(training).alias("avg_training_time"),
    ).withColumn("improvement_pct", F.when(gain > 0, gain * 100))


def epoch_improvement(df: DataFrame, keys, order, ident, perplexity: str, **kw) -> DataFrame:
    """Adds the relative fall of the perplexity against the epoch before; null after an epoch with perplexity 0."""
    def build(d, w):
        past = F.lag(perplexity).over(w)
        return d.withColumn("improvement", (past - F.col(perplexity)) / F.nullif(past, F.lit(0)))

    return over_history(df, keys, order, ident, 1, build, **kw)


def budget_efficiency(df: DataFrame, n: int) -> DataFrame:
    """Reward per selected row and the violation rate, over (budget_ratio, reward, violations, checks)."""
    return df.withColumn("data_efficiency", F.col("reward") / (F.col("budget_ratio") * n)).withColumn(
        "violation_rate", F.col("violations") / F.greatest(F.col("checks"), F.lit(1))
    )


def strategy_reward_pick(df: DataFrame, strategy: str, order: str, ident: str, reward: str, n: int = 100) -> DataFrame:
    """(strategy, mean_reward, place): mean of the last `n` rewards, best first."""
    newest = Window.partitionBy(strategy).orderBy(F.col(order).desc(), F.col(ident).desc())
    recent = df.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= n)
    means = recent.groupBy(strategy).agg(F.avg(reward).alias("mean_reward"))
    # One row per strategy from here on.
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_reward").desc(), strategy)))


def explore(picks: DataFrame, round_: Column, strategies: Sequence[str], best: Column, epsilon: float, seed: int = 0) -> Column:
    """The best strategy, or with probability `epsilon` any of them, by hash of the round."""
    from gleaner.operators.sweep import uniform

    names = F.array(*[F.lit(s) for s in strategies])
    any_ = F.element_at(names, (F.floor(uniform(seed, "arm", round_) * len(strategies)) + 1).cast("int"))
    return F.when(uniform(seed, "explore", round_) < epsilon, any_).otherwise(best)


# --- trials -----------------------------------------------------------------------


def trial_top_decile(df: DataFrame, phase: str, score: str, ident: str, **kw) -> DataFrame:
    """The max(1, n // 10) best trials of each phase."""
    sizes = df.groupBy(phase).agg(F.greatest(F.lit(1), F.floor(F.count("*") / 10)).alias("_keep"))
    return (
        group_rank(materialise(df), [phase], score, ident, descending=True, **kw)
        .join(sizes, phase)
        .filter(F.col("_rank") <= F.col("_keep"))
        .drop("_keep")
        .withColumnRenamed("_rank", "place")
    )


def weight_correlations(df: DataFrame, weights: str, names: Sequence[str] = PHASE_SCORES, threshold: float | None = 0.7) -> DataFrame:
    """Pearson correlation of every pair of weights, in one aggregate over the trials."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    wide = df.select(*[F.get(weights, F.lit(i)).alias(f"w{i}") for i in range(len(names))])
    values = wide.agg(*[F.corr(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs])
    each = F.array(*[
        F.struct(
            F.lit(names[i]).alias("score1"), F.lit(names[j]).alias("score2"), F.col(f"c{i}_{j}").alias("corr")
        )
        for i, j in pairs
    ])
    found = values.select(F.inline(each))
    return found if threshold is None else found.filter(F.abs("corr") > threshold)


def phase_dominance(df: DataFrame, phase: str, weights: str, names: Sequence[str] = PHASE_SCORES) -> DataFrame:
    """The score with the highest mean weight per phase; the first one wins ties."""
    means = df.groupBy(phase).agg(
        F.array(*[F.avg(F.get(weights, F.lit(i))) for i in range(len(names))]).alias("m")
    )
    labels = F.array(*[F.lit(n) for n in names])
    return means.select(
        phase,
        F.element_at(labels, F.array_position("m", F.array_max("m")).cast("int")).alias("dominant"),
        F.array_max("m").alias("mean_weight"),
    )


def composite_strategies(correlations: DataFrame, dominance: DataFrame, phase: str, names: Sequence[str] = PHASE_SCORES) -> DataFrame:
    """(name, score, weight): strategies from positive correlations and from dominant scores."""
    scores = F.array(*[F.lit(n) for n in names])
    synergy = correlations.filter("corr > 0").select(
        F.concat_ws("_", "score1", "score2", F.lit("synergy")).alias("name"),
        F.explode(scores).alias("score"), "score1", "score2",
    ).select(
        "name", "score",
        F.when(F.col("score").isin(F.col("score1"), F.col("score2")), 0.4).otherwise(0.1).alias("weight"),
    )
    optimised = dominance.select(
        F.concat(F.col(phase), F.lit("_optimized")).alias("name"), F.explode(scores).alias("score"), "dominant"
    ).select(
        "name", "score", F.when(F.col("score") == F.col("dominant"), 0.5).otherwise(0.1).alias("weight")
    )
    return synergy.unionByName(optimised)


def weight_history(df: DataFrame, round_: str, name: str, weight: str, names: Sequence[str]) -> DataFrame:
    """Long (round, name, weight) to one row per round."""
    return df.groupBy(round_).pivot(name, list(names)).agg(F.first(weight))


def weight_history_long(df: DataFrame, round_: str, names: Sequence[str]) -> DataFrame:
    return df.unpivot([round_], list(names), "name", "weight")


# --- state vectors ------------------------------------------------------------------


def _logs(c: Column) -> Column:
    return F.log(c + 1e-8)


def image_state(class_shares: Sequence[Column], trend: Column) -> Column:
    """19 numbers: seven run metrics, ten class shares, the trend, and a zero."""
    c = F.col
    head = [
        c("epoch") / 1000.0, c("loss"), c("accuracy"), c("gradient_norm"),
        F.log10(c("learning_rate") + 1e-10), c("seen_ratio"), c("diversity"),
    ]
    shares = (list(class_shares) + [F.lit(0.0)] * 10)[:10]
    return F.array(*[v.cast("double") for v in [*head, *shares, trend, F.lit(0.0)]])


DOMAINS = ("code", "science", "dialogue", "general")
LENGTHS = ("short", "medium", "long")


def document_state(trend: Column) -> Column:
    """17 numbers: nine run metrics, four domain and three length shares, the trend."""
    c = F.col
    head = [
        c("epoch") / 1000.0, c("loss"), c("val_loss"), _logs(c("perplexity")),
        F.log10(c("learning_rate") + 1e-10), c("tokens_seen") / F.greatest(c("total_tokens"), F.lit(1)),
        c("gradient_norm"), c("diversity"), c("memory"),
    ]
    shares = [c(f"share_{n}") for n in (*DOMAINS, *LENGTHS)]
    return F.array(*[v.cast("double") for v in [*head, *shares, trend]])


def token_state(recent: Sequence[Column], trend: Column) -> Column:
    """15 numbers: nine run metrics, the last five values and their trend."""
    c = F.col
    head = [
        c("epoch") / 100.0, _logs(c("loss")), _logs(c("perplexity")) / 10.0, _logs(c("gradient_norm")),
        F.log10(c("learning_rate") + 1e-10), c("tokens_seen") / c("total_tokens"),
        c("avg_length") / 512.0, c("vocab_coverage"), c("attention_entropy"),
    ]
    return F.array(*[v.cast("double") for v in [*head, *recent, trend]])


def environment_state(trend: Column) -> Column:
    """22 numbers: eleven run metrics, seven shares, the trend, three resource ratios."""
    c = F.col
    head = [
        c("epoch") / 1000.0, c("loss"), c("val_loss"), _logs(c("perplexity")),
        F.log10(c("learning_rate") + 1e-10), c("tokens_seen") / F.greatest(c("total_tokens"), F.lit(1)),
        c("gradient_norm"), c("memory"), c("compute"), c("diversity"),
        c("violations") / F.greatest(c("checks"), F.lit(1)),
    ]
    shares = [c(f"share_{n}") for n in (*DOMAINS, *LENGTHS)]
    tail = [trend, c("memory") / c("memory_budget"), c("compute") / c("compute_budget"), c("mean_quality")]
    return F.array(*[v.cast("double") for v in [*head, *shares, *tail]])


# Order of the landscapes in the state vector.
LANDSCAPES = ("chaotic", "plateau", "steep", "converging")


def phase_state(rewards: Sequence[Column]) -> Column:
    """Five indicators, one-hot landscape, four scalars and the mean reward per strategy."""
    c = F.col
    indicators = [c(n) for n in ("norm_change", "alignment_drop", "curvature_shift", "entropy_change", "landscape_shift")]
    one_hot = [(c("landscape") == name).cast("double") for name in LANDSCAPES]
    scalars = [c("epochs_in_phase") / 100.0, c("performance_trend"), c("memory_usage"), c("compute_used")]
    return F.array(*[v.cast("double") for v in [*indicators, *one_hot, *scalars, *rewards]])
