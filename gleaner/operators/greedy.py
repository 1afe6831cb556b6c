"""Exact greedy selection with diversity against the rows chosen so far.

The gain of a row after `t` picks is

    static * 1/(1 + rate*t)  +  weight * (distance to the nearest pick, or 1)

From the first pick on both terms only fall as picks are added (`static` is not
negative), so the gain at any earlier time is an upper bound. Each round scores the whole table once,
brings the rows with the highest gains to the driver, and picks among them as
long as the best one still beats the bound of every row left out. The result is
that of the one-by-one loop, ties to the lowest id, with far fewer passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.neighbours import _distances, _matrix
from gleaner.scale import over_history
from gleaner.scale.frames import Carry
from gleaner.session import materialise, scratch_path

FOLD_PICKS = 1024


def greedy_select(
    df: DataFrame,
    budget: int,
    vector: str = "x",
    ident: str = "id",
    static: str | None = None,
    weight: float = 1.0,
    rate: float = 0.0,
    scale: float = 1.0,
    pool: int = 512,
) -> DataFrame:
    """(rank, ident, gain) of `budget` rows picked one after the other.

    `scale` divides the distance (for example sqrt of the dimension). `pool`
    rows reach the driver per round; it changes the number of rounds only.
    The distance to the nearest pick is kept as a column and written every
    `FOLD_PICKS` picks, so a round compares rows with the picks since then, and
    a budget of any size broadcasts a bounded number of vectors.
    """
    spark = df.sparkSession
    value = F.col(static) if static else F.lit(0.0)
    base = materialise(df.select(ident, vector, value.cast("double").alias("_static"), F.lit(float("inf")).alias("_near")))
    lowest = base.agg(F.min("_static")).first()[0] or 0.0
    if lowest < 0:
        raise ValueError("static scores must not be negative")

    picked: list[tuple[int, float]] = []
    fresh_ids: list[int] = []
    vectors: list[np.ndarray] = []  # picks that are not in `_near` yet

    def nearest(rows: DataFrame) -> DataFrame:
        """`_near` brought up to date and picked rows left out, with the fresh picks only."""
        shared = spark.sparkContext.broadcast((np.array(fresh_ids), np.array(vectors)))

        @F.pandas_udf("double")
        def near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ids, chosen = shared.value
            for own, x, known in batches:
                out = known.to_numpy(float).copy()
                if len(chosen) and len(x):
                    out = np.minimum(out, _distances(_matrix(x), chosen).min(axis=1))
                    out[np.isin(own.to_numpy(), ids)] = -1.0
                yield pd.Series(out)

        return rows.withColumn("_near", near(ident, vector, "_near")).filter("_near >= 0")

    def bounds() -> DataFrame:
        discount = 1.0 / (1.0 + rate * len(picked))
        near = F.when(F.col("_near") == float("inf"), 1.0).otherwise(F.col("_near") / scale)
        scored = nearest(base).withColumn("_gain", F.col("_static") * discount + weight * near)
        return scored.orderBy(F.col("_gain").desc(), ident).limit(pool + 1)

    while len(picked) < budget:
        if len(vectors) >= FOLD_PICKS:  # written once per so many picks, so a round looks at few vectors
            base = materialise(nearest(base))
            fresh_ids.clear()
            vectors.clear()
        rows = bounds().collect()
        if not rows:
            break
        complete = len(rows) <= pool
        rest = None if complete else (rows[-1]["_gain"], -rows[-1][ident])
        discount = 1.0 / (1.0 + rate * len(picked))
        rows = rows if complete else rows[:-1]
        ids = np.array([r[ident] for r in rows])
        x = _matrix([r[vector] for r in rows])
        still = np.array([r["_static"] for r in rows])
        near = np.array([1.0 if math.isinf(r["_near"]) else r["_near"] / scale for r in rows])
        open_ = np.ones(len(rows), dtype=bool)
        while len(picked) < budget and open_.any():
            gains = still / (1.0 + rate * len(picked)) + weight * near
            gains[~open_] = -np.inf
            top = np.flatnonzero(gains == gains.max())
            best = top[np.argmin(ids[top])]
            if rest is not None:
                drop = lowest * (discount - 1.0 / (1.0 + rate * len(picked)))
                if (gains[best], -ids[best]) < (rest[0] - drop, rest[1]):
                    break
            picked.append((int(ids[best]), float(gains[best])))
            open_[best] = False
            near = np.minimum(near, _distances(x, x[best : best + 1])[:, 0] / scale)
            fresh_ids.append(int(ids[best]))
            vectors.append(x[best])
            if len(picked) == 1:  # distances may exceed the 1 of an empty selection
                break
    kind = dict(df.dtypes)[ident]
    ranked = [(i + 1, chosen, gain) for i, (chosen, gain) in enumerate(picked)]
    return spark.createDataFrame(ranked, f"rank int, {ident} {kind}, gain double")


def local_picks(rows: pd.DataFrame, budget: int, vector: str, ident: str, weight: float, scale: float) -> np.ndarray:
    """Places of `budget` rows picked one after the other among the rows of one part."""
    x, still, ids = _matrix(rows[vector]), rows["_static"].to_numpy(float), rows[ident].to_numpy()
    near, open_, out = np.ones(len(x)), np.ones(len(x), dtype=bool), []
    while len(out) < min(budget, len(x)):
        gains = np.where(open_, still + weight * near, -np.inf)
        top = np.flatnonzero(gains == gains.max())
        best = top[np.argmin(ids[top])]
        apart = _distances(x, x[best : best + 1])[:, 0] / scale
        near = apart if not out else np.minimum(near, apart)
        open_[best] = False
        out.append(best)
    return np.array(out, dtype=int)


def greedy_coreset(
    df: DataFrame, budget: int, vector: str = "x", ident: str = "id", static: str | None = None, weight: float = 1.0, scale: float = 1.0,
    part_rows: int = 4096, oversample: float = 4.0, step: float = 0.05, block: int = 4096,
) -> DataFrame:
    """(rank, ident, gain) of about the gain that `greedy_select` reaches, for budgets of any size.

    Rows are dealt by a hash into parts of about `part_rows`, each part picks greedily
    for itself, `oversample` times its share of the budget, and only what was picked
    goes on: a composable coreset. The parts' picks are merged under a descending
    threshold: it starts at the highest gain and falls by `step`, relative, whenever no
    candidate reaches it. At each threshold the driver takes a block of at most
    `block` candidates, accepts those that still reach it after the ones accepted
    before them, and writes them; the distance to the nearest pick stays a column of the
    candidates. Driver and tasks hold one block, whatever the budget.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[ident]
    value = (F.col(static) if static else F.lit(0.0)).cast("double")
    rows = df.select(ident, vector, value.alias("_static"))
    total, lowest = rows.agg(F.count("*"), F.min("_static")).first()
    if (lowest or 0.0) < 0:
        raise ValueError("static scores must not be negative")
    parts = max(1, -(-total // part_rows))
    share = max(1, math.ceil(oversample * budget / parts))

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[local_picks(part, share, vector, ident, weight, scale)].drop(columns=["_part"])

    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(parts)))
    schema = f"{ident} {kind}, {vector} array<double>, _static double"
    chosen = dealt.groupBy("_part").applyInPandas(pick, schema) if share < part_rows else rows
    open_ = materialise(chosen.withColumn("_near", F.lit(float("inf"))))
    path = scratch_path(spark, "picks")
    spark.createDataFrame([], f"rank int, {ident} {kind}, gain double").write.parquet(path)
    gain = F.col("_static") + weight * F.when(F.col("_near") == float("inf"), 1.0).otherwise(F.col("_near") / scale)
    ids, vectors, picked, bar = np.empty(0), np.empty((0, 0)), 0, None
    while picked < budget:
        if len(ids):
            open_ = materialise(_brought_near(open_, ids, vectors, ident, vector))
        top = open_.withColumn("_gain", gain).orderBy(F.col("_gain").desc(), ident).limit(block).collect()
        if not top:
            break
        if bar is None or top[0]["_gain"] < bar:
            bar = top[0]["_gain"] * (1.0 - step)
        some = [r for r in top if r["_gain"] >= bar]
        x, still = _matrix([r[vector] for r in some]), np.array([r["_static"] for r in some])
        near = np.array([1.0 if math.isinf(r["_near"]) else r["_near"] / scale for r in some])
        taken: list[int] = []
        # the first pick of all stands alone: distances may exceed the 1 of an empty selection
        for k in range(len(some) if picked else 1):
            if picked + len(taken) == budget:
                break
            if taken:
                near[k] = min(near[k], float(_distances(x[taken], x[k : k + 1]).min()) / scale)
            if still[k] + weight * near[k] >= bar:
                taken.append(k)
        out = [(picked + n + 1, some[k][ident], float(still[k] + weight * near[k])) for n, k in enumerate(taken)]
        spark.createDataFrame(out, f"rank int, {ident} {kind}, gain double").coalesce(1).write.mode("append").parquet(path)
        bar = bar if picked else None
        picked += len(taken)
        ids, vectors = np.array([some[k][ident] for k in taken]), x[taken]
    return spark.read.parquet(path)


def _brought_near(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, ident: str, vector: str) -> DataFrame:
    """`_near` brought up to date with the newest picks, and these left out."""
    if not len(ids):
        return rows
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))

    @F.pandas_udf("double")
    def near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, chosen = shared.value
        for own, x, so_far in batches:
            out = so_far.to_numpy(float).copy()
            if len(x):
                at = _matrix(x)
                for a in range(0, len(chosen), 1024):
                    out = np.minimum(out, _distances(at, chosen[a : a + 1024]).min(axis=1))
                out[np.isin(own.to_numpy(), known)] = -1.0
            yield pd.Series(out)

    return rows.withColumn("_near", near(ident, vector, "_near")).filter("_near >= 0")


def k_center(df: DataFrame, budget: int, vector: str = "x", ident: str = "id", pool: int = 512) -> DataFrame:
    """Farthest-first coverage; the first pick is the lowest id."""
    return greedy_select(df, budget, vector, ident, pool=pool)


def submodular_check(
    gains: DataFrame, sample: str, size: str, ident: str, value: str = "gain", tolerance: float = 1e-6, **kw
) -> DataFrame:
    """Checks and violations of gain(A) >= gain(B) - tolerance for nested sets.

    `gains` has the marginal gain of a sample for each prefix size. Compared
    with the lowest gain over the smaller prefixes, one check per row finds
    every prefix that takes part in a violation, with no pairs written out.
    """

    def build(d, w):
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn("_low", F.least(F.min(value).over(before), F.col("_earlier")))

    carry = {"_earlier": Carry(F.min(value), "double", F.min)}
    return (
        over_history(gains, [sample], size, ident, 0, build, carry, **kw)
        .agg(
            F.count("_low").alias("checks"),
            F.count_if(F.col("_low") < F.col(value) - tolerance).alias("violations"),
        )
        .withColumn("violation_rate", F.col("violations") / F.greatest(F.col("checks"), F.lit(1)))
    )
