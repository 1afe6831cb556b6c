"""Exact ranks and percentiles of groups of any size.

Rows are put into order-preserving buckets of bounded size. The number of rows
in the buckets before a row's own one, plus its place inside that bucket, is its
rank, so no task ever sorts more than one bucket.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000


def hash_key(ident: str | Column, seed: int | str = 0) -> Column:
    """Repeatable random order: md5 of the seed followed by the id."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), ident.cast("string")))


def _splits(bounds: Sequence[float]) -> list[float]:
    """Split points that give every bound an interval of its own.

    [v, nextafter(v)) holds the value v alone, so a value that fills many
    quantiles is known to sit in one bucket without neighbours.
    """
    splits = [-math.inf]
    for v in sorted({float(b) for b in bounds}):
        if v > splits[-1]:
            splits += [v, math.nextafter(v, math.inf)]
    if len(splits) == 1:
        splits.append(0.0)
    return splits + [math.inf]


def _bucketed(df: DataFrame, value: str, ident: str, parts: int) -> tuple[DataFrame, list[int]]:
    """Adds bucket numbers `_b` (of the value) and `_i` (of the id), and says
    which value buckets hold one value that is too frequent for one task."""
    probabilities = [i / parts for i in range(1, parts)]
    numeric = df.withColumn("_v", F.col(value).cast("double")).withColumn(
        "_n", F.col(ident).cast("double")
    )
    values, idents = numeric.approxQuantile(["_v", "_n"], probabilities, 0.25 / parts)
    value_splits = _splits(values)
    bucketizer = Bucketizer(
        splitsArray=[value_splits, _splits(idents)],
        inputCols=["_v", "_n"],
        outputCols=["_b", "_i"],
    )
    repeated = {v for v, times in Counter(values).items() if times > 1}
    heavy = [i for i, lower in enumerate(value_splits[:-1]) if lower in repeated]
    return bucketizer.transform(numeric).drop("_v", "_n"), heavy


def group_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ident: str,
    descending: bool = False,
    out: str = "_rank",
    at_most: int | Column | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """`row_number` over `keys`, ordered by `value` and then `ident` (ascending).

    `value` must be numeric without nulls and `ident` a unique number. With
    `at_most` only the first rows of each group are kept, and buckets that lie
    wholly behind that rank are dropped before the shuffle. Pass a narrow frame
    that is cheap to read twice (see ``session.materialise``).
    """
    keys = list(keys)
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(ident).asc()]
    limit = F.lit(at_most) if isinstance(at_most, int) else at_most
    parts = math.ceil(df.count() / bucket_rows)
    if parts <= 1:
        ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked if limit is None else ranked.filter(F.col(out) <= limit)

    tagged, heavy = _bucketed(df, value, ident, parts)
    tagged = tagged.withColumn(
        "_i", F.when(F.col("_b").isin(heavy), F.col("_i")).otherwise(F.lit(0.0))
    )
    if descending:
        tagged = tagged.withColumn("_b", -F.col("_b"))
    place = [*keys, "_b", "_i"]
    earlier = Window.partitionBy(*keys).orderBy("_b", "_i").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*place)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    if limit is not None:
        offsets = offsets.filter(F.col("_before") < limit)
    ranked = tagged.join(offsets, place).withColumn(
        out, F.col("_before") + F.row_number().over(Window.partitionBy(*place).orderBy(*order))
    )
    if limit is not None:
        ranked = ranked.filter(F.col(out) <= limit)
    return ranked.drop("_b", "_i", "_before")


def hash_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits that cut `rows` evenly hashed rows into buckets of at most about `bucket_rows`."""
    return max(3, math.ceil(math.log(max(rows, 1) / bucket_rows, 16)) + 1) if rows > bucket_rows else 3


def hash_prefix(
    df: DataFrame,
    keys: Sequence[str],
    ident: str,
    seed: int | str = 0,
    per_group: int | None = None,
    within: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """The first `per_group` rows of each group in hash order.

    Without `per_group` it is the size of the smallest group, taken over all
    groups or over those that agree in the `within` keys. The leading hex digits
    of the hash are the buckets: they preserve the order and are even by nature. Their number
    follows from the number of rows, so that a bucket of one group has at most
    about `BUCKET_ROWS`. Counting is a partial aggregate; only buckets before the
    cut go through the sort.
    """
    keys = list(keys)
    if digits is None:
        digits = hash_digits(df.count())
    tagged = df.withColumn("_h", hash_key(ident, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = tagged.groupBy(*keys, "_b").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if per_group is not None:
        offsets = offsets.withColumn("_limit", F.lit(per_group))
    else:
        sizes = counts.groupBy(*keys).agg(F.sum("_rows").alias("_size"))
        smallest = sizes.groupBy(*within).agg(F.min("_size").alias("_limit"))
        if within:
            offsets = offsets.join(smallest, list(within))
        else:
            offsets = offsets.withColumn("_limit", smallest.scalar())
    offsets = offsets.filter(F.col("_before") < F.col("_limit")).drop("_rows")
    place = [*keys, "_b"]
    local = F.row_number().over(Window.partitionBy(*place).orderBy("_h", ident))
    return (
        tagged.join(offsets, place)
        .withColumn("_at", F.col("_before") + local)
        .filter(F.col("_at") <= F.col("_limit"))
        .drop("_h", "_b", "_before", "_limit", "_at")
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    p: float = 0.5,
    out: str = "percentile",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Linear-interpolated percentile per group, one row per group.

    Equals ``percentile(value, p)``, which keeps all distinct values of a group
    in one task. Here only the bucket holding the wanted rank is counted out.
    """
    keys = list(keys)
    parts = math.ceil(df.count() / bucket_rows)
    bounds = (
        df.select(F.col(value).cast("double").alias("_v")).approxQuantile(
            "_v", [i / parts for i in range(1, parts)], 0.25 / parts
        )
        if parts > 1
        else []
    )
    tagged = Bucketizer(splits=_splits(bounds), inputCol="_v", outputCol="_b").transform(
        df.select(*keys, F.col(value).cast("double").alias("_v"))
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    position = F.lit(p) * (F.col("_total") - 1)
    wanted = (
        tagged.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(whole))
        .withColumn("_lo", F.floor(position))
        .withColumn("_hi", F.ceil(position))
        .filter((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_rows") > F.col("_lo")))
    )
    running = Window.partitionBy(*keys, "_b").orderBy("_v")
    values = (
        tagged.groupBy(*keys, "_b", "_v")
        .agg(F.count("*").alias("_n"))
        .join(wanted, [*keys, "_b"])
        .withColumn(
            "_end",
            F.col("_before")
            + F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
    )

    def at(rank: str) -> Column:
        inside = (F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_n"))
        return F.max(F.when(inside, F.col("_v")))

    fraction = F.lit(p) * (F.col("_t") - 1) - F.floor(F.lit(p) * (F.col("_t") - 1))
    return (
        values.groupBy(*keys)
        .agg(at("_lo").alias("_x"), at("_hi").alias("_y"), F.max("_total").alias("_t"))
        .withColumn(out, F.col("_x") + (F.col("_y") - F.col("_x")) * fraction)
        .drop("_x", "_y", "_t")
    )
