"""Choosing rows: top-k, ratios, pools, random draws and set operations on ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.scale import broadcast_if_small, group_rank, hash_key, hash_prefix
from gleaner.scale.broadcasts import BROADCAST_ROWS
from gleaner.session import materialise

TOPK_ROWS = 5_000  # what one task merges from each partition


def top_k(df: DataFrame, score: str, ident: str, k: int) -> DataFrame:
    """The `k` highest scores; equal scores go to the lowest id.

    A small `k` is a TakeOrderedAndProject. A large one would end in a single
    task, so it is cut by rank instead.
    """
    if k <= TOPK_ROWS:
        return df.orderBy(F.col(score).desc(), F.col(ident).asc()).limit(k)
    return group_rank(materialise(df), [], score, ident, descending=True, at_most=k).drop("_rank")


def budget(n: int, ratio: float) -> int:
    return math.floor(n * ratio)


def top_ratio(df: DataFrame, score: str, ident: str, ratio: float) -> DataFrame:
    """The highest-scored `int(n * ratio)` rows."""
    return top_k(df, score, ident, budget(df.count(), ratio))


def random_select(df: DataFrame, ident: str, k: int, seed: int = 0) -> DataFrame:
    """`k` rows without replacement, the same ones in every run."""
    if k <= TOPK_ROWS:
        return df.orderBy(hash_key(ident, seed), ident).limit(k)
    return hash_prefix(df, [], ident, seed, k)


def pool_then_top_k(df: DataFrame, score: str, ident: str, k: int, factor: int = 5, seed: int = 0) -> DataFrame:
    """Top-k inside a random pool of `factor * k` rows."""
    return top_k(random_select(df, ident, factor * k, seed), score, ident, k)


def restrict(df: DataFrame, chosen: DataFrame, ident: str, at_most: int) -> DataFrame:
    """Rows of `df` whose id is among at most `at_most` chosen ones.

    Ids are ranked and joined back, so that texts never go through the task
    that finds the best ones.
    """
    ids = chosen.select(ident)
    return df.join(F.broadcast(ids) if at_most <= BROADCAST_ROWS else ids, ident, "left_semi")


def random_pool(df: DataFrame, ident: str, k: int, seed: int = 0) -> DataFrame:
    """`random_select` for wide rows."""
    return restrict(df, random_select(df.select(ident), ident, k, seed), ident, k)


def domain_pool(df: DataFrame, domain: str, ident: str, k: int, factor: int = 5) -> DataFrame:
    """The `factor * k` rows most relevant to a domain; all rows for `general`."""
    if domain == "general":
        return df
    scores = df.select(ident, T.domain_relevance(F.col("text"), domain).alias("domain_score"))
    return restrict(df, top_k(scores, "domain_score", ident, factor * k), ident, factor * k)


def split_head_tail(df: DataFrame, ident: str, val_size: int) -> DataFrame:
    """Adds `part`: the last `val_size` rows by id are validation, the rest training."""
    first = top_k(df.select(ident), ident, ident, val_size).agg(F.min(ident)).scalar()
    return df.withColumn("part", F.when(F.col(ident) >= first, "validation").otherwise("train"))


def keep_selected(df: DataFrame, selected: DataFrame, ident: str) -> DataFrame:
    """The rows of the dataset that are in the coreset."""
    return df.join(broadcast_if_small(selected.select(ident)), ident, "left_semi")


def exclude_selected(df: DataFrame, selected: DataFrame, ident: str) -> DataFrame:
    """The candidates that are not in the coreset yet."""
    return df.join(broadcast_if_small(selected.select(ident)), ident, "left_anti")


def check_constraint(df: DataFrame, size: Column, max_gap: float = 0.05, max_size: int = 1000) -> DataFrame:
    """Summary of |loss_full - loss_coreset| <= `max_gap` and size <= `max_size` over checks."""
    gap = F.abs(F.col("loss_full") - F.col("loss_coreset"))
    return df.agg(
        F.avg(gap).alias("avg_epsilon"),
        F.max(gap).alias("max_epsilon"),
        F.avg((gap <= max_gap).cast("double")).alias("satisfaction_rate"),
        F.avg((size <= max_size).cast("double")).alias("size_ok_rate"),
        F.count("*").alias("total_checks"),
    )
