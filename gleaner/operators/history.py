"""Scores from a sample's or a run's history.

All functions take a frame with one row per (key, step) and look back a fixed
number of rows, or carry one running value along, so histories of any length
are cut into chunks by ``over_history``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.scale import over_history
from gleaner.scale.frames import CHUNK_ROWS, Carry


def last(w, n: int):
    """Frame of the current row and the `n - 1` rows before it."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def forgetting(df: DataFrame, keys: Sequence[str], order: str, ident: str, loss: str, n: int = 10, **kw) -> DataFrame:
    """Share of the steps among the last `n` losses at which the loss rose."""

    def build(d, w):
        rose = F.when(F.col(loss) > F.lag(loss).over(w), 1).otherwise(0)
        d = d.withColumn("_rose", F.when(F.col("_rank") > 1, rose).otherwise(0))
        d = d.withColumn("_pairs", F.least(F.col("_rank"), F.lit(n)) - 1)
        rises = F.sum("_rose").over(last(w, n - 1))
        return d.withColumn(
            "forgetting", F.when(F.col("_pairs") > 0, rises / F.col("_pairs")).otherwise(0.0)
        ).drop("_rose", "_pairs")

    return over_history(df, keys, order, ident, n, build, **kw)


def sample_memory(
    df: DataFrame, keys: Sequence[str], order: str, ident: str,
    uncertainty: str = "uncertainty", selected: str = "selected", impact: str = "impact",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds volatility, staleness, the mean impact so far and whether the sample was ever selected.

    Steps count from 0. Staleness is the distance to the last selection before
    the step, or the step itself if there was none.
    """
    step = F.col("_rank") - 1

    def build(d, w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        chosen_at = F.when(F.col(selected), step)
        previous = F.greatest(F.max(chosen_at).over(before), F.col("_chosen"))
        mine = F.col("_chunk") == F.col("_home") if "_chunk" in d.columns else F.lit(True)
        own = F.when(mine, F.col(impact))
        impacts = F.coalesce(F.sum(own).over(upto), F.lit(0.0)) + F.coalesce("_impact", F.lit(0.0))
        counted = F.count(own).over(upto) + F.coalesce("_impacts", F.lit(0))
        frame = last(w, 10)
        return (
            d.withColumn("step", step)
            .withColumn("volatility", F.when(F.col("_rank") > 1, F.var_pop(uncertainty).over(frame)).otherwise(0.0))
            .withColumn("staleness", step - F.coalesce(previous, F.lit(0)))
            .withColumn("impact_mean", F.when(counted > 0, impacts / counted).otherwise(0.0))
            .withColumn("ever_selected", previous.isNotNull() | F.col(selected))
        )

    carry = {
        "_chosen": Carry(F.max(F.when(F.col(selected), step)), "bigint", F.max),
        "_impact": Carry(F.sum(impact), "double", F.sum),
        "_impacts": Carry(F.count(impact), "bigint", F.sum),
    }
    return over_history(df, keys, order, ident, 10, build, carry, chunk_rows).drop("_rank")


def memory_stats(memory: DataFrame, sample: str) -> DataFrame:
    """Mean and spread of volatility, share never selected, mean staleness, over the latest row per sample."""
    latest = memory.groupBy(sample).agg(
        F.max_by(F.struct("volatility", "staleness", "ever_selected"), "step").alias("m")
    )
    return latest.agg(
        F.avg("m.volatility").alias("volatility_mean"),
        F.stddev_pop("m.volatility").alias("volatility_std"),
        F.avg((~F.col("m.ever_selected")).cast("double")).alias("exploration_potential"),
        F.avg("m.staleness").alias("average_staleness"),
    )


def selection_coverage(df: DataFrame, sample: str, round_: str, total: Column) -> DataFrame:
    """Per round: distinct samples selected so far, as a share of the dataset."""
    first = df.groupBy(sample).agg(F.min(round_).alias(round_))
    new = first.groupBy(round_).agg(F.count("*").alias("new_samples"))
    picks = df.groupBy(round_).agg(F.count("*").alias("picks"))
    per_round = picks.join(new, round_, "left").na.fill(0, ["new_samples"])
    # One row per round: rounds are the steps of a run, not data rows.
    upto = Window.orderBy(round_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_round.withColumn("coverage", F.sum("new_samples").over(upto) / total)


def gradient_variance(df: DataFrame, keys, order, ident, values: str = "grads", n: int = 10, **kw) -> DataFrame:
    """Sample variance of each parameter over the last `n` rows, averaged over the parameters."""

    def spread(series: Column) -> Column:
        return V.pop_variance(series) * F.size(series) / (F.size(series) - 1)

    def build(d, w):
        d = d.withColumn("_seen", F.collect_list(values).over(last(w, n)))
        per_parameter = F.transform(
            values,
            lambda _, j: V.let(F.transform("_seen", lambda row: F.get(row, j)), spread),
        )
        return d.withColumn(
            "gradient_variance",
            F.when(F.col("_rank") > 1, V.mean(per_parameter)).otherwise(0.0),
        ).drop("_seen")

    return over_history(df, keys, order, ident, n, build, **kw)


def trajectory(df: DataFrame, keys, order, ident, value: str, n: int = 50, prefix: str = "", **kw) -> DataFrame:
    """Mean, spread, current value, mean slope and range over the last `n` values."""

    def build(d, w):
        return trajectory_columns(d, w, value, n, prefix)

    return over_history(df, keys, order, ident, n, build, **kw)


def trajectory_columns(d: DataFrame, w, value: str, n: int, prefix: str) -> DataFrame:
    """The mean slope telescopes: with central differences inside and one-sided
    ones at the ends, only two values at either end of the frame remain."""
    frame = last(w, n)
    v = F.col(value)
    ends = 1.5 * v - 0.5 * F.lag(value).over(w) + 0.5 * F.nth_value(value, 2).over(frame) - 1.5 * F.first(value).over(frame)
    return (
        d.withColumn(f"{prefix}mean", F.avg(value).over(frame))
        .withColumn(f"{prefix}std", F.coalesce(F.stddev_pop(value).over(frame), F.lit(0.0)))
        .withColumn(f"{prefix}current", v)
        .withColumn(f"{prefix}trend", F.coalesce(ends / F.count(value).over(frame), F.lit(0.0)))
        .withColumn(f"{prefix}range", F.max(value).over(frame) - F.min(value).over(frame))
    )


# Order of the run series and of the strategies in the state vector.
STATE_TRAJECTORIES = ("loss", "train_accuracy", "val_accuracy", "gradient_norm")
STATE_STRATEGIES = ("grad_mag", "diversity", "uncertainty", "boundary", "forgetting")
DEFAULT_LEARNING_RATE = 0.001


def run_state_vector(df: DataFrame, keys, order, ident, n: int = 50, **kw) -> DataFrame:
    """Adds `state`, the 37 numbers that describe a run at each step.

    Input columns: the four series, learning_rate, selection_entropy, and
    reward_<s> / usage_<s> per strategy (null where not logged).
    """

    def build(d, w):
        frame = last(w, n)
        parts = []
        for name in (*STATE_TRAJECTORIES, "selection_entropy"):
            d = trajectory_columns(d, w, name, n, f"_{name}_")
        for name in STATE_TRAJECTORIES:
            parts += [F.col(f"_{name}_{k}") for k in ("mean", "std", "current", "trend", "range")]
        parts.append(F.coalesce(F.last("learning_rate", ignorenulls=True).over(frame), F.lit(DEFAULT_LEARNING_RATE)))
        parts += [F.col(f"_selection_entropy_{k}") for k in ("mean", "std", "current", "trend", "range")]
        for s in STATE_STRATEGIES:
            parts += [F.coalesce(F.avg(f"{k}_{s}").over(frame), F.lit(0.0)) for k in ("reward", "usage")]
        first = F.first("loss").over(frame)
        progress = 1.0 - F.col("loss") / (first + 1e-8)
        parts.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress)))
        named = [p.alias(f"_s{i}") for i, p in enumerate(parts)]
        kept = [c for c in d.columns if not (c.startswith("_") and c.split("_")[-1] in ("mean", "std", "current", "trend", "range"))]
        return d.select(*kept, *named).withColumn(
            "state", F.array(*[F.col(f"_s{i}").cast("double") for i in range(len(parts))])
        ).drop(*[f"_s{i}" for i in range(len(parts))])

    return over_history(df, keys, order, ident, n, build, **kw)


def trend_columns(d: DataFrame, w, value: str) -> DataFrame:
    """Relative change over 5 points, mean and relative change over 3 points; 0 if too short."""
    v = F.col(value)

    def relative(back: int) -> Column:
        past = F.lag(value, back).over(w)
        return F.coalesce((v - past) / (F.abs(past) + 1e-8), F.lit(0.0))

    return (
        d.withColumn("trend5", relative(4))
        .withColumn("trend3_mean", F.coalesce((v - F.lag(value, 2).over(w)) / 3.0, F.lit(0.0)))
        .withColumn("trend3_relative", relative(2))
    )


def perf_trend(df: DataFrame, keys, order, ident, value: str, **kw) -> DataFrame:
    return over_history(df, keys, order, ident, 4, lambda d, w: trend_columns(d, w, value), **kw)
