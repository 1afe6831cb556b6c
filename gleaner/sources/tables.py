"""Readers for the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T

SPREAD_SPLITS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, ident: str) -> DataFrame:
    """`df` over all cores where its files fill fewer tasks than there are cores.

    Parquet splits at row groups, so a small table in one group runs in one
    task. Only tables of at most `SPREAD_SPLITS` splits are dealt out: a larger
    one is never shuffled for the sake of cores, however many there are.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if splits >= cores or splits > SPREAD_SPLITS else df.repartition(min(cores, 8 * SPREAD_SPLITS), ident)


def corpus(df: DataFrame, ident: str = "doc_id", text: str = "text", cap: int | None = None) -> DataFrame:
    """Stripped non-empty texts under their source position, with word counts.

    Ids keep the gaps that empty texts leave; `cap` keeps the first rows by id.
    """
    loaded = (
        df.withColumn(text, T.stripped(F.col(text)))
        .filter(F.col(text) != "")
        .withColumn("n_words", T.word_count(F.col(text)))
    )
    return loaded if cap is None else loaded.orderBy(ident).limit(cap)


def text_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds quality and complexity to a corpus."""
    c = F.col(text)
    return (
        T.with_words(df, text)
        .withColumn("quality", T.quality(c, F.col("words")))
        .withColumn("complexity", T.complexity(c, F.col("words")))
        .drop("words")
    )


def write_metadata(df: DataFrame, path: str) -> DataFrame:
    """Keep the scores as a table and read them back: a cache that any job can join."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
