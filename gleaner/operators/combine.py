"""Normalising, weighting and combining scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.vectors import let, total
from gleaner.scale import over_history

# Weights of the scores per profile and per phase.
STRATEGY_PROFILES = {
    "explore": {"uncertainty": 1.0, "volatility": 0.8, "gradient": 0.3},
    "exploit": {"impact": 1.0, "gradient": 0.7, "uncertainty": 0.2},
    "refresh": {"staleness": 1.0, "diversity": 0.5},
    "balance": {"diversity": 1.0, "uncertainty": 0.5, "impact": 0.5},
    "focus": {"difficulty": 1.0, "gradient": 0.8},
}
PHASE_SCORES = (
    "gradient_magnitude", "diversity", "uncertainty", "boundary", "forgetting", "class_balance",
)
PHASE_WEIGHTS = {
    "early": (0.3, 0.4, 0.1, 0.1, 0.05, 0.05),
    "middle": (0.35, 0.2, 0.15, 0.15, 0.1, 0.05),
    "late": (0.2, 0.1, 0.2, 0.2, 0.2, 0.1),
    "transition": (0.25, 0.25, 0.15, 0.15, 0.1, 0.1),
}


def zscore_sigmoid(
    df: DataFrame, keys: Sequence[str], order: str, ident: str, value: str, out: str, n: int = 100, **kw
) -> DataFrame:
    """Sigmoid of the z-score against the `n` scores before a row.

    The raw score goes into the sigmoid until more than 10 earlier ones exist.
    """

    def build(d, w):
        frame = w.rowsBetween(-n, -1)
        z = (F.col(value) - F.avg(value).over(frame)) / (F.stddev_pop(value).over(frame) + 1e-8)
        used = F.when(F.col("_rank") > 11, z).otherwise(F.col(value))
        return d.withColumn("_z", used).withColumn(out, 1.0 / (1.0 + F.exp(-F.col("_z")))).drop("_z")

    return over_history(df, keys, order, ident, n, build, **kw)


def weighted_sum(scores: dict[str, Column], weights: dict[str, float | Column]) -> Column:
    """Sum of weight * score over the names both have."""
    result = F.lit(0.0)
    for name, weight in weights.items():
        if name in scores:
            result = result + weight * scores[name]
    return result


def curriculum_sum(
    scores: dict[str, Column], weights: dict[str, float], level: Column, preference: dict[str, float]
) -> Column:
    """`weighted_sum` with the difficulty weight scaled by the preference for the row's level."""
    pairs = [x for k, v in preference.items() for x in (F.lit(k), F.lit(v))]
    preferred = F.element_at(F.create_map(*pairs), level)
    return weighted_sum(scores, {k: (w * preferred if k == "difficulty" else F.lit(w)) for k, w in weights.items()})


def strategy_scores(
    df: DataFrame, ident: str, scores: Sequence[str], profiles: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """(ident, strategy, score) for all profiles in one pass over the rows."""
    profiles = profiles or STRATEGY_PROFILES
    columns = {s: F.col(s) for s in scores}
    each = [
        F.struct(F.lit(name).alias("strategy"), weighted_sum(columns, weights).alias("score"))
        for name, weights in profiles.items()
    ]
    return df.select(ident, F.inline(F.array(*each)))


def composed(scores: Sequence[Column], operators: Sequence[str], weights: Sequence[float]) -> Column:
    """Left fold of weighted scores with add, multiply, max or min."""
    fold = {
        "add": lambda a, b: a + b,
        "multiply": lambda a, b: a * b,
        "max": F.greatest,
        "min": F.least,
    }
    result = scores[0] * float(weights[0])
    for op, score, weight in zip(operators, scores[1:], weights[1:]):
        result = fold[op](result, score * float(weight))
    return result


def phase_weights(phase: Column) -> Column:
    """Array of the weights of a phase in `PHASE_SCORES` order; unknown phases use `middle`."""
    default = F.array(*[F.lit(w) for w in PHASE_WEIGHTS["middle"]])
    choice = F.when(F.lit(False), default)
    for name, weights in PHASE_WEIGHTS.items():
        choice = choice.when(phase == name, F.array(*[F.lit(w) for w in weights]))
    return choice.otherwise(default)


def adjusted_weights(
    weights: Column, variance: Column, variance_mean: Column, forgetting: Column, imbalance: Column
) -> Column:
    """Raise the weights that recent dynamics call for, and make them sum to 1."""
    factors = F.array(
        F.when(variance > variance_mean, 1.1).otherwise(1.0),
        F.lit(1.0),
        F.lit(1.0),
        F.lit(1.0),
        F.when(forgetting > 0.1, 1.2).otherwise(1.0),
        F.when(imbalance > 0.3, 1.3).otherwise(1.0),
    )
    raised = F.zip_with(weights, factors, lambda w, f: w * f)
    return let(raised, lambda r: let(total(r), lambda s: F.transform(r, lambda w: w / s)))


def normalise_weights(df: DataFrame, keys: Sequence[str], weight: str = "weight", out: str = "share") -> DataFrame:
    """weight / (sum of the group's weights + 1e-8); a group is one weight vector."""
    whole = F.sum(weight).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.col(weight) / (whole + 1e-8))


def reward_weights(df: DataFrame, strategy: str, order: str, ident: str, reward: str, n: int = 50) -> DataFrame:
    """(strategy, ema, weight): softmax of 10 * EMA over the last `n` rewards of each strategy.

    The newest `n` rows are found with a partial top-n per strategy.
    """
    newest = Window.partitionBy(strategy).orderBy(F.col(order).desc(), F.col(ident).desc())
    recent = df.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= n)
    means = recent.groupBy(strategy).agg(
        F.sum(0.1 * F.pow(F.lit(0.9), F.col("_age") - 1) * F.col(reward)).alias("ema")
    )
    raised = means.withColumn("_w", F.exp(F.col("ema") * 10))
    return raised.select(strategy, "ema", (F.col("_w") / raised.agg(F.sum("_w")).scalar()).alias("weight"))


def dominant_weight(df: DataFrame, keys: Sequence[str], name: str, weight: str, ordinal: str) -> DataFrame:
    """Name of the largest weight per group; the first one wins ties."""
    best = F.max_by(F.col(name), F.struct(F.col(weight), -F.col(ordinal)))
    return df.groupBy(*keys).agg(best.alias("dominant"), F.max(weight).alias("weight"))


def phase_objective(phase: Column) -> Column:
    """Trial score by phase from the trial's metric columns."""
    c = F.col
    return (
        F.when(phase == "early", 0.7 * c("accuracy") + 0.3 * c("diversity"))
        .when(phase == "middle", 0.6 * c("accuracy") + 0.2 * c("compression") + 0.2 * c("speed"))
        .when(phase == "late", 0.8 * c("accuracy") + 0.2 * c("hard_coverage"))
        .otherwise(0.5 * c("accuracy") + 0.5 * (1 - c("loss_variance")))
    )


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    """1 - smallest / largest class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg((1 - F.min("n") / F.max("n")).alias("class_imbalance"))
