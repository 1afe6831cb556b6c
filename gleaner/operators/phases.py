"""Phase changes of a run: curvature, alignment, indicators, segments and labels.

Input: one row per (run, step) with columns norm, alignment, loss and entropy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.operators.history import last
from gleaner.scale import group_rank, numeric_order, over_history
from gleaner.session import materialise

# Weights of the indicators in the transition score.
INDICATOR_WEIGHTS = {
    "norm_change": 0.3,
    "alignment_drop": 0.25,
    "curvature_shift": 0.2,
    "entropy_change": 0.15,
    "landscape_shift": 0.1,
}
WINDOW = 50
SENSITIVITY = 2.0
MIN_LENGTH = 10


def curvature_columns(d: DataFrame, w, loss: str = "loss", lagged: bool = True, out: str = "curvature") -> DataFrame:
    """|second difference| of the losses, first difference with two points, else 0.

    By default the losses before the current step are used, as the online form
    does; `lagged=False` includes the current one.
    """
    shift = 1 if lagged else 0

    def at(k: int) -> Column:
        return F.lag(loss, k + shift).over(w) if k + shift else F.col(loss)

    n = F.col("_rank") - shift
    second = F.abs(at(0) - 2 * at(1) + at(2))
    return d.withColumn(out, F.when(n >= 3, second).when(n == 2, F.abs(at(0) - at(1))).otherwise(0.0))


def curvature(df: DataFrame, keys, order, ident, loss: str = "loss", lagged: bool = True, **kw) -> DataFrame:
    return over_history(
        df, keys, order, ident, 4, lambda d, w: curvature_columns(d, w, loss, lagged), **kw
    )


def indicator_columns(d: DataFrame, w) -> DataFrame:
    """The five indicators over the last 50 steps; zeros before the fifth step."""
    d = curvature_columns(d, w)
    for name in ("norm", "entropy"):
        d = _slope_columns(d, w, name)

    n = F.col("_rank")
    drop = F.greatest(F.lit(0.0), F.avg("alignment").over(last(w, 5)) - F.col("alignment"))
    recent = F.avg("curvature").over(last(w, 5))
    past = F.avg("curvature").over(w.rowsBetween(-9, -5))
    recent_var = F.var_pop("loss").over(last(w, 10))
    past_var = F.var_pop("loss").over(w.rowsBetween(-19, -10))
    d = (
        d.withColumn("_drop", drop)
        .withColumn("_recent", recent)
        .withColumn("_past", past)
        .withColumn("_rv", recent_var)
        .withColumn("_pv", F.when(n >= 20, past_var).otherwise(recent_var))
    )
    enough = n >= 5
    shift = F.abs(F.col("_recent") - F.col("_past")) / (F.col("_past") + 1e-8)
    landscape = F.abs(F.col("_rv") - F.col("_pv")) / (F.col("_pv") + 1e-8)
    return (
        d.withColumn("norm_change", F.when(enough, _jump("norm")).otherwise(0.0))
        .withColumn("alignment_drop", F.when(enough, F.col("_drop")).otherwise(0.0))
        .withColumn("curvature_shift", F.when(n >= 10, shift).otherwise(0.0))
        .withColumn("entropy_change", F.when(enough, _jump("entropy")).otherwise(0.0))
        .withColumn("landscape_shift", F.when(enough, landscape).otherwise(0.0))
        .drop("_drop", "_recent", "_past", "_rv", "_pv", *[f"_{n}_{k}" for n in ("norm", "entropy") for k in ("in", "head", "tail", "mean", "var", "n")])
    )


def _slope_columns(d: DataFrame, w, value: str) -> DataFrame:
    """Numerical gradient of the last 50 values as window aggregates.

    The central slope at the row before is known at each row, so the inner
    slopes are a frame over it; the two ends are one-sided.
    """
    v = F.col(value)
    d = d.withColumn(f"_{value}_in", (v - F.lag(value, 2).over(w)) / 2)
    window, inner = last(w, WINDOW), last(w, WINDOW - 2)
    first, second = F.first(value).over(window), F.nth_value(value, 2).over(window)
    return (
        d.withColumn(f"_{value}_head", second - first)
        .withColumn(f"_{value}_tail", v - F.lag(value).over(w))
        .withColumn(f"_{value}_mean", F.avg(f"_{value}_in").over(inner))
        .withColumn(f"_{value}_var", F.var_pop(f"_{value}_in").over(inner))
        .withColumn(f"_{value}_n", F.count(f"_{value}_in").over(inner))
    )


def _jump(value: str) -> Column:
    """|last slope| over the spread of the slopes: the inner ones merged with both ends."""
    head, tail, inner, var, k = (F.col(f"_{value}_{x}") for x in ("head", "tail", "mean", "var", "n"))
    m = k + 2
    mean = (k * inner + head + tail) / m

    def square(x: Column) -> Column:
        return x * x

    spread = (k * var + k * square(inner - mean) + square(head - mean) + square(tail - mean)) / m
    return F.abs(tail) / (F.sqrt(spread) + 1e-8)


def transition_score() -> Column:
    total = F.lit(0.0)
    for name, weight in INDICATOR_WEIGHTS.items():
        total = total + weight * F.col(name)
    return total


def detection_columns(d: DataFrame, w, cooldown: int = 0) -> DataFrame:
    """Adds the score, its mean over 5 steps, the transition flag and its confidence."""
    mean = F.avg("score").over(last(w, 5))
    d = d.withColumn("score", transition_score()).withColumn("score_mean", mean)
    d = d.withColumn(
        "is_transition", (F.col("_rank") >= MIN_LENGTH) & (F.col("score_mean") > SENSITIVITY)
    )
    if cooldown:
        before = F.max(F.col("is_transition").cast("int")).over(w.rowsBetween(-cooldown, -1))
        d = d.withColumn("is_transition", F.col("is_transition") & (F.coalesce(before, F.lit(0)) == 0))
    confidence = F.least(F.col("score_mean") / (SENSITIVITY * 2), F.lit(1.0))
    return d.withColumn("confidence", F.when(F.col("is_transition"), confidence).otherwise(0.0))


BACK = WINDOW + 4 + 5


def transition_indicators(df: DataFrame, keys, order, ident, **kw) -> DataFrame:
    return over_history(df, keys, order, ident, BACK, indicator_columns, **kw)


def detect_phases(df: DataFrame, keys, order, ident, cooldown: int = 0, **kw) -> DataFrame:
    return over_history(
        df, keys, order, ident, BACK + cooldown,
        lambda d, w: detection_columns(indicator_columns(d, w), w, cooldown), **kw,
    )


def landscape() -> Column:
    return (
        F.when(F.col("curvature_shift") > 2.0, "chaotic")
        .when(F.col("landscape_shift") < 0.1, "plateau")
        .when(F.col("norm_change") > 3.0, "steep")
        .otherwise("converging")
    )


def landscape_strategy(kind: Column) -> Column:
    return (
        F.when(kind == "chaotic", "diversity")
        .when(kind == "plateau", "uncertainty")
        .when(kind == "steep", "gradient_magnitude")
        .otherwise("hybrid")
    )


def phase_segments(df: DataFrame, keys: Sequence[str], order, ident, **kw) -> DataFrame:
    """One row per phase: its first and last epoch and what it looked like at its start.

    A transition at an epoch ends the phase and starts the next one there; the
    phase before the first transition is `chaotic` and led by `uncertainty`.
    Ends are found by looking back one start in reverse order.
    """

    def build(d, w):
        d = detection_columns(indicator_columns(d, w), w)
        window = last(w, WINDOW)
        return (
            d.withColumn("avg_gradient_norm", F.avg("norm").over(window))
            .withColumn("gradient_stability", F.avg("alignment").over(window))
            .withColumn("loss_variance", F.var_pop("loss").over(window))
            .withColumn("selection_diversity", F.avg("entropy").over(window))
        )

    facts = ("avg_gradient_norm", "gradient_stability", "loss_variance", "selection_diversity")
    steps = over_history(df, keys, order, ident, BACK, build, **kw)
    epoch = F.col("_rank") - 1
    # few rows, and read twice below: written, so the detection above runs once
    starts = materialise(steps.filter("is_transition").select(
        *keys, epoch.alias("start_epoch"), landscape().alias("landscape"), *facts
    ).withColumn("strategy", landscape_strategy(F.col("landscape"))))
    opening = df.select(*keys).distinct().select(
        *keys,
        F.lit(0).cast("long").alias("start_epoch"),
        F.lit("chaotic").alias("landscape"),
        *[F.lit(None).cast("double").alias(f) for f in facts],
        F.lit("uncertainty").alias("strategy"),
    )
    backwards = opening.unionByName(starts).withColumn("_back", -F.col("start_epoch"))
    return over_history(
        backwards, keys, "_back", "start_epoch", 1,
        lambda d, w: d.withColumn("end_epoch", F.lag("start_epoch").over(w)), **kw,
    ).drop("_back", "_rank")


def phase_summary(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transitions and mean length of the finished phases per run."""
    length = F.col("end_epoch") - F.col("start_epoch")
    return segments.groupBy(*keys).agg(
        F.count("end_epoch").alias("num_transitions"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_phase_length"),
    )


def phase_label(df: DataFrame, keys, order, ident, **kw) -> DataFrame:
    """Adds early / middle / late / transition from the last 10 losses and norms."""

    def build(d, w):
        d = d.withColumn("_var", F.var_pop("loss").over(last(w, 10)))
        d = d.withColumn("_norm", F.avg("norm").over(last(w, 10)))
        label = (
            F.when(F.col("_rank") < 10, "early")
            .when((F.col("_var") > 0.1) | (F.col("_norm") > 1.0), "early")
            .when((F.col("_var") < 0.01) & (F.col("_norm") < 0.1), "late")
            .when(F.abs("alignment") > 0.8, "transition")
            .otherwise("middle")
        )
        return d.withColumn("phase", label).drop("_var", "_norm")

    return over_history(df, keys, order, ident, 10, build, **kw)


DECAY = 0.9
BLOCK = 64


def _alignments(vectors: np.ndarray, rank: int, mean: np.ndarray | None) -> np.ndarray:
    """Cosines of consecutive gradients from step `rank` on to the mean before each.

    `mean` is the running mean before the first of them (null before step 2).
    Steps go through in blocks: inside a block the means are one product with a
    triangular matrix of decays.
    """
    out = np.ones(len(vectors))
    start = 0
    if rank == 1:
        start = min(2, len(vectors))
        mean = vectors[1] if len(vectors) > 1 else None
    elif rank == 2:
        start, mean = 1, vectors[0]
    steps = np.arange(BLOCK + 1)
    age = steps[:, None] - 1 - steps[None, :BLOCK]
    decay = np.where(age >= 0, (1 - DECAY) * DECAY ** np.maximum(age, 0), 0.0)
    for at in range(start, len(vectors), BLOCK):
        g = vectors[at : at + BLOCK]
        n = len(g)
        means = DECAY ** steps[: n + 1, None] * mean + decay[: n + 1, :n] @ g
        before = means[:n]
        size = np.maximum(np.linalg.norm(g, axis=1), 1e-8) * np.maximum(np.linalg.norm(before, axis=1), 1e-8)
        out[at : at + n] = np.einsum("ij,ij->i", g, before) / size
        mean = means[n]
    return out


def alignment_ema(
    df: DataFrame, keys: Sequence[str], order: str, ident: str, vector: str = "grad", chunk_rows: int = 100_000
) -> DataFrame:
    """Cosine of each gradient to the running mean 0.9 * mean + 0.1 * gradient before it.

    1.0 for the first two calls: the first only starts the history, the second
    starts the mean. Histories longer than `chunk_rows` are cut: a first pass
    folds each chunk to one vector (a decayed sum), a running fold of those
    gives the mean every chunk starts from, and a second pass computes the
    cosines of all chunks in parallel.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    of_keys = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{of_keys}, `{ident}` {kinds[ident]}, _rank long, alignment double"
    narrow = df.select(*keys, ident, vector, numeric_order(df, order).alias("_order"))
    long = narrow.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows)
    if long.isEmpty():
        return narrow.groupBy(*keys).applyInPandas(_whole_history(keys, ident, vector), schema)

    ranked = group_rank(materialise(narrow), keys, "_order", ident, bucket_rows=chunk_rows).drop("_order")
    ranked = materialise(
        ranked.withColumn("_rank", F.col("_rank").cast("long"))
        .withColumn("_chunk", F.floor((F.col("_rank") - 1) / chunk_rows))
    )
    # Gradient 1 does not enter the mean, gradient 2 enters with weight 1.
    sizes = ranked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    age = F.col("_size") - (F.col("_rank") - 1) % chunk_rows - 1
    share = F.when(F.col("_rank") == 1, 0.0).when(F.col("_rank") == 2, 1.0).otherwise(1 - DECAY)
    weight = share * F.pow(F.lit(DECAY), age.cast("double"))
    sums = (
        ranked.join(sizes, [*keys, "_chunk"])
        .select(*keys, "_chunk", "_size", weight.alias("_w"), F.posexplode(vector).alias("_p", "_g"))
        .groupBy(*keys, "_chunk", "_size", "_p")
        .agg(F.sum(F.col("_w") * F.col("_g")).alias("_g"))
        .groupBy(*keys, "_chunk", "_size")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_g"))), lambda s: s["_g"]).alias("_sum"))
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk").reset_index(drop=True)
        starts, mean = [], None
        for size, total in zip(pdf["_size"], pdf["_sum"]):
            starts.append(mean)
            total = np.asarray(total, dtype=np.float64)
            mean = total if mean is None else mean * DECAY**size + total
        pdf["_start"] = starts
        return pdf[[*keys, "_chunk", "_start"]]

    def cosines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank").reset_index(drop=True)
        start = pdf["_start"].iloc[0]
        mean = None if start is None else np.asarray(start, dtype=np.float64)
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
        pdf["alignment"] = _alignments(vectors, int(pdf["_rank"].iloc[0]), mean)
        return pdf[[*keys, ident, "_rank", "alignment"]]

    starts = sums.groupBy(*keys).applyInPandas(fold, f"{of_keys}, _chunk long, _start array<double>")
    return ranked.join(starts, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(cosines, schema)


def _whole_history(keys: list[str], ident: str, vector: str):
    def cosines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", ident]).reset_index(drop=True)
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]])
        pdf["_rank"] = np.arange(1, len(pdf) + 1)
        pdf["alignment"] = _alignments(vectors, 1, None)
        return pdf[[*keys, ident, "_rank", "alignment"]]

    return cosines
