from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import sweep
from gleaner.scale import against


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [(int(k), float(m), *map(float, np.round(x, 1))) for k, (m, x) in enumerate(zip(rng.normal(size=900), rng.normal(size=(900, 3)), strict=True))]
    return spark.createDataFrame(data, "id long, loss double, a double, b double, c double").repartition(5)


def brute(rows, population, k):
    """Fitness by the definition, strategy by strategy."""
    data = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[0])
    at = {"a": 2, "b": 3, "c": 4}
    out = {}
    for s, terms in population:
        scored = []
        for r in data:
            value = r[at[terms[0]["score"]]] * terms[0]["weight"]
            for t in terms[1:]:
                v = r[at[t["score"]]] * t["weight"]
                value = {"add": value + v, "multiply": value * v, "max": max(value, v), "min": min(value, v)}[t["op"]]
            scored.append((-value, r[0], r[1]))
        out[s] = np.mean([m for _, _, m in sorted(scored)[:k]])
    return out


def test_fitness_is_that_of_the_definition(spark, rows):
    population = sweep.initial_population(spark, ("a", "b", "c"), 40)
    found = dict(sweep.evaluate(rows, population, "id", "loss", 30).collect())
    expected = brute(rows, [(r["strategy"], r["terms"]) for r in population.collect()], 30)
    assert found.keys() == expected.keys()
    assert all(abs(found[s] - expected[s]) < 1e-12 for s in found)


def test_thousands_of_strategies_in_one_scan(spark, rows, tmp_path, capsys):
    rows.write.parquet(str(tmp_path / "rows"))
    population = sweep.initial_population(spark, ("a", "b", "c"), 5000)
    found = sweep.evaluate(spark.read.parquet(str(tmp_path / "rows")), population, "id", "loss", 10)
    found.explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 1 and len(plan) < 6000  # strategies are no expressions
    fitness = dict(found.collect())
    assert len(fitness) == 5000
    some = population.filter(F.col("strategy") % 500 == 0).collect()
    for s, value in brute(rows, [(r["strategy"], r["terms"]) for r in some], 10).items():
        assert abs(fitness[s] - value) < 1e-12


def test_bounded_heaps_merge_to_the_best_of_all():
    rng = np.random.default_rng(1)
    score, ident = np.round(rng.normal(size=2000), 1), rng.permutation(2000)
    parts = []
    for a in range(0, 2000, 500):  # four tasks, fed in pieces
        best = sweep.Best(7)
        for b in range(a, a + 500, 50):
            best.add(3, score[b : b + 50], ident[b : b + 50], score[b : b + 50])
            assert best.held <= 28 + 50
        parts += list(best.drain())
        assert best.held == 0 and not best.rows
    merged = sorted((-s, i) for _, ss, ids, _ in parts for s, i in zip(ss, ids, strict=True))[:7]
    assert merged == sorted(zip(-score, ident, strict=True))[:7]


def test_nulls_rank_last_and_do_not_count(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 0.5), (3, None, 0.9), (4, 4.0, float("nan"))], "id long, loss double, a double")
    one = spark.createDataFrame([(0, [("a", "add", 1.0)])], sweep.STRATEGY_SCHEMA)
    fitness = lambda k: sweep.evaluate(rows, one, "id", "loss", k).first()["fitness"]
    assert fitness(1) is None and fitness(2) == 2.0 and fitness(3) == 1.5 and abs(fitness(9) - 7 / 3) < 1e-12
    assert sweep.evaluate(rows.limit(0), one, "id", "loss", 2).count() == 0
    assert sweep.evaluate(rows, one.limit(0), "id", "loss", 2).count() == 0


def test_generations_are_written_and_never_get_worse(spark, rows):
    population = sweep.initial_population(spark, ("a", "b", "c"), 20)
    done = sweep.evolve(rows, population, "id", "loss", 30, generations=4, rate=0.4)
    history = {r["generation"]: r for r in done.history(spark).collect()}
    assert sorted(history) == [0, 1, 2, 3] and done.generations == 4
    assert all(history[g]["best"] <= history[g + 1]["best"] for g in range(3))
    assert all(history[g]["strategy"] == 0 or history[g]["best"] > history[g - 1]["best"] for g in (1, 2, 3))  # the elite is in slot 0
    table = done.table(spark)
    assert table.count() == 80 and table.filter("fitness IS NULL").count() == 0
    again = sweep.evolve(rows.repartition(2), population, "id", "loss", 30, generations=4, rate=0.4)
    assert table.exceptAll(again.table(spark)).count() == 0  # draws do not depend on the partitions


def test_evolution_stops_when_nothing_improves(spark, rows):
    population = sweep.initial_population(spark, ("a", "b", "c"), 10)
    still = sweep.evolve(rows, population, "id", "loss", 30, generations=9, rate=0.0, patience=2)
    assert still.generations == 3  # without mutation the best stays: one generation to set it, two without a gain
    assert sweep.evolve(rows, population, "id", "loss", 30, generations=9, rate=0.9, patience=1, tolerance=1e9).generations == 2


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_every_block_meets_every_block(spark, monkeypatch, limit):
    monkeypatch.setattr("gleaner.scale.blocks.BROADCAST_BYTES", limit)
    left, right = spark.range(0, 103, 1, 5), spark.range(0, 37, 1, 3).withColumn("w", F.lit(2.0))

    def work(pairs):
        import pandas as pd

        for _, rows, _, members in pairs:
            ids, others = rows.column("id").to_numpy(), members.column("id").to_numpy()
            yield pd.DataFrame({"a": np.repeat(ids, len(others)), "b": np.tile(others, len(ids))})

    pairs = against(left, right, work, "a long, b long", 10, 4)
    assert pairs.count() == 103 * 37 and pairs.distinct().count() == 103 * 37
