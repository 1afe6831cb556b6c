"""Duplicate removal, sizes of a Bloom filter, quantised scores and the bounded cache."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.select import top_k


def filter_size(capacity: int, error_rate: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter."""
    bits = int(-capacity * math.log(error_rate) / math.log(2) ** 2)
    return bits, int(bits * math.log(2) / capacity)


def bit_positions(item: Column, bits: int, hashes: int) -> Column:
    """md5(item followed by the hash number) mod `bits`, for each hash number.

    The 128-bit number is reduced as two 64-bit halves.
    """
    wrap = (1 << 64) % bits

    def position(i: int) -> Column:
        digest = F.md5(F.concat(item, F.lit(str(i))))
        high, low = (
            F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") for start in (1, 17)
        )
        return (((high % bits) * wrap + low % bits) % bits).cast("long")

    return F.array(*[position(i) for i in range(hashes)])


def build_filter(items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """The set bits, one row each. Filters merge by union and distinct, and the
    distinct is combined on the map side, so a repeated item costs nothing."""
    return items.select(F.explode(bit_positions(F.col(item), bits, hashes)).alias("bit")).distinct()


def might_contain(items: DataFrame, item: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Adds `seen`: whether all bits of the item are set.

    Only distinct items are probed; the answers are joined back to the rows.
    """
    probes = items.select(item).distinct().select(
        item, F.explode(bit_positions(F.col(item), bits, hashes)).alias("bit")
    )
    hits = (
        probes.join(filter_bits.withColumn("_set", F.lit(True)), "bit", "left")
        .groupBy(item)
        .agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("seen"))
    )
    return items.join(hits, item)


def first_occurrences(df: DataFrame, content: Column, ident: str) -> DataFrame:
    """One row per distinct content: the lowest id, by a partial aggregate on the hash.

    No window per content: a text with a third of all copies is one reduced row
    per map task.
    """
    return df.groupBy(F.md5(content).alias("content_hash")).agg(
        F.min(ident).alias(ident), F.count("*").alias("copies")
    )


def exact_dedup(df: DataFrame, content: Column, ident: str) -> DataFrame:
    return df.join(first_occurrences(df, content, ident).select(ident), ident, "left_semi")


def new_texts(earlier: DataFrame, batch: DataFrame, content: Column, ident: str) -> DataFrame:
    """First copies of the contents of `batch` that `earlier` does not hold.

    An anti join on the hash of reduced sides: each content is one row a side,
    whatever its copies, and there is no capacity that a filter could exceed.
    """
    seen = earlier.select(F.md5(content).alias("content_hash")).distinct()
    return first_occurrences(batch, content, ident).join(seen, "content_hash", "left_anti")


def quantise(df: DataFrame, score: str, levels: int = 65_535) -> DataFrame:
    """Scores as integers on the range [min(0, lowest), max(1, highest)]."""
    low = df.agg(F.least(F.lit(0.0), F.min(score))).scalar()
    high = df.agg(F.greatest(F.lit(1.0), F.max(score))).scalar()
    ranged = df.withColumn("_low", low).withColumn("_high", high)
    share = (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return ranged.withColumn(
        "quantised", F.when(F.col("_high") > F.col("_low"), F.floor(share * levels)).otherwise(0).cast("int")
    ).drop("_low", "_high")


def newest(df: DataFrame, age: str, ident: str, size: int) -> DataFrame:
    """The `size` newest entries."""
    return top_k(df, age, ident, size)


def evict(df: DataFrame, age: str, ident: str, limit: int, share: float = 0.2) -> DataFrame:
    """Drop the oldest `share` of the entries if there are more than `limit`."""
    n = df.count()
    return df if n <= limit else top_k(df, age, ident, n - int(n * share))
