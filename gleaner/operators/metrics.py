"""Distribution and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors as V


def _entropy_of(counts: DataFrame, n: str, eps: float) -> DataFrame:
    share = F.col(n) / counts.agg(F.sum(n)).scalar()
    return counts.withColumn("_p", share).agg(
        F.coalesce(-F.sum(F.col("_p") * F.log(F.col("_p") + eps)), F.lit(0.0)).alias("entropy")
    )


def histogram_entropy(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Entropy over min(bins, n) equal-width bins of the values, the last bin closed."""
    bounds = df.agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.least(F.lit(bins), F.count("*")).alias("b")
    )
    ranged = df.select(value, bounds.select(F.struct("lo", "hi", "b")).scalar().alias("_r"))
    width = (F.col("_r.hi") - F.col("_r.lo")).cast("double")
    place = F.when(
        width > 0,
        F.least(F.floor((F.col(value) - F.col("_r.lo")) / width * F.col("_r.b")), F.col("_r.b") - 1),
    ).otherwise(0)
    return _entropy_of(ranged.groupBy(place.alias("bin")).agg(F.count("*").alias("n")), "n", 1e-8)


def frequency_entropy(df: DataFrame, ident: str) -> DataFrame:
    """Entropy of how often each id was selected."""
    return _entropy_of(df.groupBy(ident).agg(F.count("*").alias("n")), "n", 1e-10)


def class_distribution(df: DataFrame, kind: Column | str) -> DataFrame:
    kind = F.col(kind) if isinstance(kind, str) else kind
    sizes = df.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    return sizes.select("class", "n", (F.col("n") / sizes.agg(F.sum("n")).scalar()).alias("share"))


def mod_bins(df: DataFrame, ident: str, bins: int = 10) -> DataFrame:
    return df.groupBy(F.pmod(F.col(ident), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def loss_summary(df: DataFrame, epoch: Sequence[str], loss: str, tokens: str) -> DataFrame:
    return df.groupBy(*epoch).agg(
        F.avg(loss).alias("avg_loss"),
        F.exp(F.avg(loss)).alias("avg_perplexity"),
        F.stddev_pop(loss).alias("loss_std"),
        F.sum(tokens).alias("total_tokens"),
    )


def accuracy_loss(signals: DataFrame) -> DataFrame:
    """Accuracy in percent and mean cross-entropy, over (p, y, loss)."""
    hit = (V.argmax(F.col("p")) == F.col("y")).cast("double")
    return signals.agg(
        (100 * F.avg(hit)).alias("accuracy"), F.avg("loss").alias("avg_loss")
    )


def batch_mean_loss(df: DataFrame, position: str, loss: str, batch: int = 128) -> DataFrame:
    """Mean of the batch means, with batches cut by position."""
    means = df.groupBy(F.floor(F.col(position) / batch).alias("b")).agg(F.avg(loss).alias("m"))
    return means.agg(F.avg("m").alias("batch_mean_loss"), F.count("*").alias("batches"))


def language_eval(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    return df.agg(
        F.avg(loss).alias("loss"),
        F.exp(F.avg(loss)).alias("perplexity"),
        (F.sum(tokens) / F.count("*")).alias("tokens_per_sample"),
    )


def coverage_by_round(df: DataFrame, round_: str, word: str, size: float | Column | None = None, precision: int = 14) -> DataFrame:
    """(round, seen, coverage): about how many distinct words the selections up to each round used, and their share.

    Each round has one mergeable sketch, built in partial aggregates; later rounds
    merge the earlier ones' instead of counting their words again, and new rounds can be
    merged with sketches that were kept. `size` is that of the vocabulary, by default
    what all rounds used. The error is about 1.04 / sqrt(2^precision).
    """
    rounds = df.groupBy(F.col(round_).alias("round")).agg(F.hll_sketch_agg(word, precision).alias("sketch"))
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each round
    merged = rounds.withColumn("seen", F.hll_sketch_estimate(F.hll_union_agg("sketch").over(upto)))
    whole = F.lit(size) if isinstance(size, (int, float)) else size
    if whole is None:
        whole = F.max("seen").over(Window.partitionBy())
    return merged.select("round", "seen", F.least(F.col("seen") / whole, F.lit(1.0)).alias("coverage"))
