"""Neighbours, greedy selection, strategies and properties, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner import registry
from gleaner.operators import corrupt, greedy, neighbours, stratify, sweep
from gleaner.plans.corpus import scored_documents
from gleaner.plans.signals import signal_table, vectors


@pytest.fixture(scope="module")
def points(spark):
    """Three groups of vectors, one with half of all, and exact copies."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 6)) * 3
    x = centres[np.minimum(np.arange(240) % 4, 2)] + rng.normal(size=(240, 6))
    x[200:220] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    return df.cache(), x


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("pivots,block", [(None, 4096), (9, 16), (40, 7)])
def test_knn(points, pivots, block):
    df, x = points
    got = {}
    for r in neighbours.knn(df, df, 4, exclude_self=True, pivots=pivots, block_rows=block).collect():
        got.setdefault(r["id"], []).append(r["distance"])
    want = np.sort(distances(x), axis=1)[:, :4]
    assert len(got) == len(x)
    for i in range(len(x)):
        assert sorted(got[i]) == pytest.approx(want[i])


def test_knn_with_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id long, x array<double>")
    got = {r["id"]: r["diversity"] for r in neighbours.knn_diversity(df.withColumn("x", F.array(F.get("x", F.lit(0)), F.lit(1.0)))).collect()}
    assert got[1] == pytest.approx(got[2])
    alone = df.limit(1)
    assert neighbours.knn_diversity(alone).first()["diversity"] == 0.0


def test_min_distance_beyond_the_broadcast_bound(points, monkeypatch):
    df, x = points
    chosen = df.filter("id % 7 = 0")
    small = {r["id"]: r["min_distance"] for r in neighbours.min_distance(df, chosen).collect()}
    monkeypatch.setattr(neighbours, "BROADCAST_VECTORS", 5)
    large = {r["id"]: r["min_distance"] for r in neighbours.min_distance(df, chosen).collect()}
    assert small == pytest.approx(large)
    empty = neighbours.min_distance(df, df.filter("id < 0"))
    assert empty.filter("min_distance is not null").count() == 0


def brute_greedy(x, static, budget, weight, rate, scale):
    near, picked = np.ones(len(x)), []
    for t in range(budget):
        gain = static / (1 + rate * t) + weight * near
        gain[picked] = -np.inf
        best = int(np.argmax(gain))
        d = np.sqrt(((x - x[best]) ** 2).sum(1)) / scale
        near = d if not picked else np.minimum(near, d)
        picked.append(best)
    return picked


@pytest.mark.parametrize("pool", [8, 40, 512])
@pytest.mark.parametrize("weight,rate,scale", [(1.0, 0.0, 1.0), (0.3, 0.05, 2.0), (0.0, 0.1, 1.0)])
def test_greedy(points, pool, weight, rate, scale):
    df, x = points
    static = np.abs(np.sin(np.arange(len(x)))) + 0.5
    scored = df.withColumn("s", F.abs(F.sin(F.col("id"))) + 0.5)
    got = greedy.greedy_select(scored, 25, static="s", weight=weight, rate=rate, scale=scale, pool=pool)
    assert [r["id"] for r in got.orderBy("rank").collect()] == brute_greedy(x, static, 25, weight, rate, scale)


def test_k_center_radius_never_grows(points):
    df, _ = points
    rows = greedy.k_center(df, 30, pool=16).orderBy("rank").collect()
    gains = [r["gain"] for r in rows]
    assert rows[0]["id"] == 0
    assert len({r["id"] for r in rows}) == 30
    assert all(a >= b - 1e-9 for a, b in zip(gains[1:], gains[2:]))


def test_greedy_stops_when_rows_run_out(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, x array<double>")
    assert greedy.k_center(df, 5).count() == 2


def test_strategies(spark, folder):
    df = signal_table(spark, folder).select("id", "x", "p", "y").cache()
    for name in registry.STRATEGIES:
        assert registry.select_with(name, df, 10).count() == 10
    terms = [("grad_mag", "add", 0.5), ("uncertainty", "max", 0.5)]
    assert registry.select_with("composed", df, 10, terms=terms).count() == 10
    assert registry.select_with("weighted", df, 10, weights={"boundary": 1.0}).count() == 10
    with pytest.raises(ValueError):
        registry.select_with("no_such_strategy", df, 10)


def test_registry_names(spark, folder):
    scorers = registry.signal_scorers()
    with pytest.raises(ValueError):
        scorers.register("boundary", ["p"], lambda _: F.lit(1.0))
    with pytest.raises(ValueError):
        scorers.apply(vectors(spark, folder))
    kept = scorers.subset(["boundary"]).apply(signal_table(spark, folder))
    assert "boundary" in kept.columns and "influence" not in kept.columns


def test_user_pandas_scorer(spark, folder):
    @F.pandas_udf("double")
    def length(x: pd.Series) -> pd.Series:
        return x.map(len).astype("float64")

    mine = registry.ScorerRegistry()
    mine.register("length", ["x"], lambda _: length("x"))
    assert {r["score"] for r in mine.combine(vectors(spark, folder), {"length": 2.0}).collect()} == {128.0}


def test_text_scorers(spark, folder):
    from gleaner.functions.text import with_words

    docs = with_words(scored_documents(spark, folder))
    scored = registry.text_scorers(0.5).combine(docs, {"quality": 0.5, "curriculum": 0.5})
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_score_ranges(spark, folder):
    row = scored_documents(spark, folder).agg(
        F.min("quality"), F.max("quality"), F.min("complexity"), F.max("complexity")
    ).first()
    assert all(0 <= v <= 1 for v in row)


def test_balanced_strata_are_equal(spark, folder):
    scored = scored_documents(spark, folder).withColumn("s", stratify.score_bin(F.col("complexity"), 5))
    sizes = {r["count"] for r in stratify.balanced_sample(scored, "s", "doc_id").groupBy("s").count().collect()}
    assert len(sizes) == 1
    assert stratify.balanced_sample(scored, "s", "doc_id", balanced=False).count() == scored.count()


def test_ties_go_to_the_lowest_id(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(100)], "id long, s double").repartition(8)
    from gleaner.operators.select import top_k

    assert sorted(r["id"] for r in top_k(df, "s", "id", 10).collect()) == list(range(10))


@pytest.mark.parametrize("kind", [k for k in corrupt.CORRUPTIONS if k != "fog"])
def test_corrupted_values_stay_in_range(spark, kind):
    px = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i * 37 % 64) / 63.0)
    images = spark.range(5).select("id", px.alias("px"))
    grid = corrupt.corrupt_grid(images, [kind], (1, 3, 5), corrupt.Shape(4, 4, 4))
    row = grid.agg(F.count("*"), F.min(F.array_min("px")), F.max(F.array_max("px")), F.min(F.size("px"))).first()
    assert row[0] == 15 and row[3] == 64
    assert row[1] >= 0 and row[2] <= 1
    again = corrupt.corrupt_grid(images.repartition(3), [kind], (1, 3, 5), corrupt.Shape(4, 4, 4))
    assert grid.exceptAll(again).count() == 0


def test_unknown_corruption(spark):
    with pytest.raises(ValueError):
        corrupt.corrupt_grid(spark.range(1), ["rain"], (1,), corrupt.Shape(1, 8, 8))


def test_mutation_keeps_weights_in_range(spark):
    population = sweep.initial_population(spark, ("a", "b"))
    changed = sweep.mutate(population, rate=0.9)
    weights = changed.select(F.explode("terms.weight").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert 0 <= weights[0] and weights[1] <= 1
    assert changed.exceptAll(population).count() > 0
    assert sweep.mutate(population, rate=0.0).exceptAll(population).count() == 0


def test_elite_survives(spark):
    fitness = spark.createDataFrame([(i, float(i % 13)) for i in range(50)], "strategy int, fitness double")
    rows = {r["slot"]: r for r in sweep.tournament(fitness, 50).collect()}
    assert len(rows) == 50 and rows[0]["winner"] == 12 and rows[0]["fitness"] == 12.0
