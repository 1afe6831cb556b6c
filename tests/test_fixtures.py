"""Hand-computed values of single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gleaner.functions import signals as S
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import combine, corrupt, dedup, history, metrics, stratify

CAT = "The cat sat. The dog ran."
REPEAT = "Sample text " * 10


def one(spark, df_or_column, **columns):
    df = spark.createDataFrame([Row(**columns)]) if columns else spark.range(1)
    return df.select(df_or_column).first()[0]


@pytest.mark.parametrize(
    "text,quality,complexity,score,entropy",
    [
        (CAT, 0.6, 0.216667, 0.342428, 1.56071),
        ("a a a a", 0.35, 0.116667, 0.135, 0.0),
        (REPEAT, 0.5, 0.583333, 0.357726, 0.693147),
    ],
)
def test_text_scores(spark, text, quality, complexity, score, entropy):
    df = T.with_words(spark.createDataFrame([Row(text=text)]).withColumn("text", T.stripped(F.col("text"))))
    c, w = F.col("text"), F.col("words")
    row = df.select(
        T.quality(c, w), T.complexity(c, w), T.quality_rci(c, w)["score"], T.word_entropy(w), T.word_count(c) == F.size(w)
    ).first()
    assert tuple(row)[:4] == pytest.approx((quality, complexity, score, entropy), abs=1e-6)
    assert row[4]


def test_empty_text(spark):
    df = T.with_words(spark.createDataFrame([("",), (None,)], "text string"))
    c, w = F.coalesce(F.col("text"), F.lit("")), F.col("words")
    for row in df.select(T.quality_rci(c, w)["score"], T.word_entropy(w), T.complexity(c, w), T.curriculum(F.size(w), 0.0)).collect():
        assert tuple(row) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "progress,expected", [(0.0, (0.75, 0.0, 0.0)), (0.5, (0.16667, 1.0, 0.0)), (0.9, (0.1, 0.6, 1.0))]
)
def test_curriculum(spark, progress, expected):
    got = [r[0] for r in spark.createDataFrame([(50,), (300,), (700,)], "n int").select(T.curriculum(F.col("n"), progress)).collect()]
    assert got == pytest.approx(expected, abs=1e-4)


def test_topic_without_keyword(spark):
    assert one(spark, T.topic(F.lit("xyzzy plugh"))) == "science"
    assert one(spark, T.topic(F.lit("an Election about music and film"))) == "culture"
    assert one(spark, T.domain_relevance(F.lit("import numpy"), "unknown")) == 0.0


def test_signals(spark):
    p = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    assert one(spark, S.uncertainty(p)) == pytest.approx(1.029653, abs=1e-6)
    assert one(spark, S.boundary(p)) == pytest.approx(0.367879, abs=1e-6)
    soft = S.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))
    assert one(spark, soft) == pytest.approx([0.5, 0.5])


def test_gradient(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, 2, 4, 8)])
    assert one(spark, V.gradient(v)) == pytest.approx([1, 1.5, 3, 4])
    assert one(spark, V.gradient(F.array(F.lit(3.0)))) == [0.0]


def series(spark, values, name="v"):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], f"k string, i long, {name} double")


def last_row(df):
    return df.orderBy(F.col("i").desc()).first()


def test_forgetting(spark):
    df = series(spark, [3, 2, 2.5, 2.4, 2.6, 2.6], "loss")
    assert last_row(history.forgetting(df, ["k"], "i", "i", "loss"))["forgetting"] == pytest.approx(0.4)


def test_volatility_and_staleness(spark):
    rows = [("a", i, float(v), s, None) for i, (v, s) in enumerate([(1, False), (2, True), (4, False), (4, False)])]
    df = spark.createDataFrame(rows, "k string, i long, uncertainty double, selected boolean, impact double")
    got = history.sample_memory(df, ["k"], "i", "i").orderBy("i").collect()
    assert got[2]["volatility"] == pytest.approx(1.555556, abs=1e-6)
    assert [r["staleness"] for r in got] == [0, 1, 1, 2]
    assert [r["impact_mean"] for r in got] == [0.0] * 4


def test_trajectory(spark):
    row = last_row(history.trajectory(series(spark, [1, 2, 4, 8]), ["k"], "i", "i", "v"))
    assert [row[c] for c in ("mean", "std", "current", "trend", "range")] == pytest.approx([3.75, 2.680951, 8, 2.375, 7], abs=1e-6)
    first = history.trajectory(series(spark, [5]), ["k"], "i", "i", "v").first()
    assert [first[c] for c in ("mean", "std", "current", "trend", "range")] == [5, 0, 5, 0, 0]


def test_reward_weights(spark):
    rows = [("a", i, float(r)) for i, r in enumerate((1, 0, 2))] + [("b", i, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "strategy string, i long, reward double")
    got = {r["strategy"]: r for r in combine.reward_weights(df, "strategy", "i", "i", "reward").collect()}
    assert got["a"]["ema"] == pytest.approx(0.281)
    assert (got["a"]["weight"], got["b"]["weight"]) == pytest.approx((0.943214, 0.056786), abs=1e-6)


def test_histogram_entropy(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 5, 9, 10)], "id long")
    assert metrics.histogram_entropy(df, "id", 5).first()[0] == pytest.approx(1.05492, abs=1e-5)
    same = spark.createDataFrame([(3,), (3,)], "id long")
    assert metrics.histogram_entropy(same, "id").first()[0] == pytest.approx(0.0, abs=1e-6)


def test_quantile_bins_leave_out_the_maximum(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 100)], "n int")
    assert one_list(stratify.quantile_bin(df, "n", 3)) == [0, 0, 1, 1, 2, None]
    assert one_list(stratify.quantile_bin(df, "n", 3, include_max=True)) == [0, 0, 1, 1, 2, 2]


def one_list(df):
    return [r["stratum"] for r in df.orderBy("n").collect()]


def test_bloom_filter(spark):
    assert dedup.filter_size(20000) == (191701, 6)
    assert dedup.filter_size(100) == (958, 6)
    assert one(spark, dedup.bit_positions(F.lit("doc-1"), 958, 6)) == [61, 750, 304, 546, 846, 666]


def test_bloom_filter_has_no_false_negatives(spark):
    items = spark.range(300).select(F.concat(F.lit("t"), "id").alias("h"))
    bits = dedup.build_filter(items, "h", 958, 6)
    assert dedup.might_contain(items, "h", bits, 958, 6).filter("not seen").count() == 0


def test_adjusted_weights(spark):
    got = one(spark, combine.adjusted_weights(combine.phase_weights(F.lit("early")), F.lit(2.0), F.lit(1.0), F.lit(0.2), F.lit(0.0)))
    assert got == pytest.approx([0.317308, 0.384615, 0.096154, 0.096154, 0.057692, 0.048077], abs=1e-6)
    assert sum(got) == pytest.approx(1.0)


@pytest.mark.parametrize("severity,step", [(1, 32), (3, 64), (5, 256)])
def test_jpeg_step(spark, severity, step):
    px = F.array(*[F.lit(v / 255) for v in (31, 32, 64, 255)])
    got = one(spark, corrupt.jpeg_quantise(px, F.lit(severity), F.lit(1), corrupt.Shape(1, 2, 2)))
    assert got == pytest.approx([(v // step) * step / 255 for v in (31, 32, 64, 255)])
