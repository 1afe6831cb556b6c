"""The skew-proof paths give what the plain ones give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import analytics, combine, greedy, history, phases
from gleaner.operators.novelty import ngram_novelty_ordered
from gleaner.operators.select import top_k
from gleaner.plans.history import KEY, _run_series, events, steps
from gleaner.scale import exact_percentiles, group_rank, hash_prefix
from gleaner.sources.tables import corpus, table


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, one value a third of those."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{i % 40}"
        value = 7.0 if rng.random() < 0.34 else round(rng.uniform(0, 20), 1)
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id long, key string, v double").repartition(4).cache()


def same(a, b):
    def rounded(df):
        return sorted(
            (tuple(round(x, 6) if isinstance(x, float) else (tuple(round(y, 6) for y in x) if isinstance(x, list) else x) for x in r) for r in df.collect()),
            key=repr,
        )

    assert rounded(a) == rounded(b)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("keys", [["key"], []])
def test_group_rank(skewed, keys, descending):
    order = F.col("v").desc() if descending else F.col("v")
    want = skewed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "id")))
    got = group_rank(skewed, keys, "v", "id", descending, bucket_rows=100)
    same(got.select("id", "_rank"), want.select("id", "_rank"))
    cut = group_rank(skewed, keys, "v", "id", descending, at_most=33, bucket_rows=100)
    same(cut.select("id", "_rank"), want.filter("_rank <= 33").select("id", "_rank"))


def test_hash_prefix(skewed):
    want = (
        skewed.withColumn("h", F.md5(F.concat(F.lit("4:"), F.col("id").cast("string"))))
        .withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("h", "id")))
    )
    same(hash_prefix(skewed, ["key"], "id", 4, 25).select("id"), want.filter("n <= 25").select("id"))
    sizes = hash_prefix(skewed, ["key"], "id", 4).groupBy("key").count()
    smallest = skewed.groupBy("key").count().agg(F.min("count")).first()[0]
    assert {r["count"] for r in sizes.collect()} == {smallest}
    same(hash_prefix(skewed.repartition(7), ["key"], "id", 4).select("id"), hash_prefix(skewed, ["key"], "id", 4).select("id"))


@pytest.mark.parametrize("p", [0.0, 0.33, 0.5, 0.9, 1.0])
def test_exact_percentiles(skewed, p):
    want = skewed.groupBy("key").agg(F.percentile("v", p).alias("percentile"))
    same(exact_percentiles(skewed, ["key"], "v", p, bucket_rows=100), want)


def test_large_top_k(skewed, monkeypatch):
    want = skewed.orderBy(F.col("v").desc(), "id").limit(500)
    monkeypatch.setattr("gleaner.operators.select.TOPK_ROWS", 10)
    same(top_k(skewed, "v", "id", 500), want)


def hot_events(spark, folder):
    """A third of all events belong to user 1."""
    df = events(spark, folder)
    return df.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))


OPERATORS = {
    "forgetting": lambda d, **kw: history.forgetting(d, *KEY, "value", **kw).select("event_id", "forgetting"),
    "memory": lambda d, **kw: history.sample_memory(
        d.withColumns({"uncertainty": F.col("value"), "selected": F.col("event_type") == "purchase",
                       "impact": F.when(F.col("event_type") == "click", F.col("value"))}), *KEY, **kw
    ).select("event_id", "step", "volatility", "staleness", "impact_mean", "ever_selected"),
    "gradient_variance": lambda d, **kw: history.gradient_variance(
        d.withColumn("grads", F.array("value", F.col("k").cast("double"))), *KEY, **kw
    ).select("event_id", "gradient_variance"),
    "trajectory": lambda d, **kw: history.trajectory(d, *KEY, "value", **kw).select("event_id", "mean", "std", "trend", "range"),
    "perf_trend": lambda d, **kw: history.perf_trend(d, *KEY, "value", **kw).select("event_id", "trend5", "trend3_mean"),
    "zscore": lambda d, **kw: combine.zscore_sigmoid(d, *KEY, "value", "s", **kw).select("event_id", "s"),
    "improvement": lambda d, **kw: analytics.improvement_vs_first(d, *KEY, "value", **kw).select("event_id", "improvement", "best"),
    "submodular": lambda d, **kw: greedy.submodular_check(d, "user_id", "ts", "event_id", "value", **kw),
    "detect": lambda d, **kw: phases.detect_phases(
        d.select("user_id", "ts", "event_id", (F.col("value") / 50).alias("norm"), F.cos(F.col("k") / 25).alias("alignment"),
                 (F.col("value") / 100).alias("loss"), F.log(F.col("k") + 1).alias("entropy")), *KEY, **kw
    ).select("event_id", "score", "is_transition", "confidence"),
    "segments": lambda d, **kw: phases.phase_segments(
        d.select("user_id", "ts", "event_id", (F.col("value") / 50).alias("norm"), F.cos(F.col("k") / 25).alias("alignment"),
                 (F.col("value") / 100).alias("loss"), F.log(F.col("k") + 1).alias("entropy")), *KEY, **kw
    ).select("user_id", "start_epoch", "end_epoch", "landscape", "strategy"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_chunked_history(spark, folder, name):
    df = hot_events(spark, folder).cache()
    run = OPERATORS[name]
    same(run(df, chunk_rows=120), run(df))


def test_chunked_state_vector(spark, folder):
    df = _run_series(spark, folder).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id"))).cache()
    run = lambda **kw: history.run_state_vector(df, *KEY, **kw).select("event_id", "state")
    same(run(chunk_rows=120), run())


def test_chunked_alignment(spark, folder):
    grad = F.array(F.col("value") / 50, F.cos(F.col("k") / 25), F.lit(1.0))
    df = hot_events(spark, folder).select("user_id", "ts", "event_id", grad.alias("grad")).cache()
    run = lambda n: phases.alignment_ema(df, *KEY, chunk_rows=n).select("event_id", "_rank", "alignment")
    same(run(37), run(100_000))


def test_chunked_novelty(spark, folder):
    docs = corpus(table(spark, folder, "documents")).select("doc_id", "text").cache()
    same(ngram_novelty_ordered(docs, n=1, chunk_rows=20), ngram_novelty_ordered(docs, n=1))


def test_cooldown(spark, folder):
    df = steps(spark, folder)
    free = phases.detect_phases(df, *KEY).filter("is_transition").count()
    held = phases.detect_phases(df, *KEY, cooldown=20).filter("is_transition").count()
    assert held <= free


def test_results_do_not_depend_on_partitions(spark, folder):
    df = events(spark, folder)
    run = OPERATORS["detect"]
    same(run(df.repartition(7)), run(df.coalesce(1)))


def test_quantile_edges_of_many_values(spark):
    import numpy as np

    from gleaner.operators import stratify

    values = np.random.default_rng(3).integers(0, 400, 900)
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(values)], "id long, v long").repartition(5)
    for distinct in (1_000, 50):  # one buffer of all values, or a bucket for each edge
        edges = df.limit(1).select(stratify.quantile_edges(df, "v", 4, distinct).alias("e")).first()["e"]
        assert edges == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]).tolist())
