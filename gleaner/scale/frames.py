"""Window functions over ordered histories whose groups may be huge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gleaner.scale.broadcasts import broadcast_if_small, collect_bounded
from gleaner.scale.ranks import group_rank
from gleaner.session import materialise

CHUNK_ROWS = 1_000_000
KEY_BUCKETS = 65_536


@dataclass(frozen=True)
class Carry:
    """A running value: the aggregate `column` of each chunk, folded over all earlier chunks."""

    column: Column
    kind: str  # the SQL type of the value
    fold: Callable[[str], Column] = F.sum  # F.sum, F.max, F.min or F.first


def over_history(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ident: str,
    back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    carry: dict[str, Carry] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Apply window expressions to each key's rows in (`order`, `ident`) order.

    `build(frame, w)` adds columns with `w`; the frame has the row's place in
    its history in `_rank` (from 1). Its expressions may look back at most
    `back` rows. Values that depend on the whole past come in through `carry`
    as columns of that name (null for the first rows of a history).

    Keys with more than `chunk_rows` rows are cut into chunks along the order;
    each chunk starts with a copy of the last `back` rows before it, and those
    copies are dropped at the end. All other keys take the plain window.
    """
    keys = list(keys)
    carry = carry or {}
    if back >= chunk_rows:
        raise ValueError("chunk_rows must exceed back")
    # Counted by buckets of keys first: many different keys need not travel for that.
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).alias("_bucket")
    full = df.groupBy(bucket).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows).select("_bucket")
    full = [r[0] for r in collect_bounded(full, KEY_BUCKETS, "full buckets")]
    if not full:
        return _plain(df, keys, order, ident, build, carry)
    some = df.select(*keys, bucket).join(F.broadcast(df.sparkSession.createDataFrame([(b,) for b in full], "_bucket long")), "_bucket")
    hot = some.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows).drop("_n")
    if hot.isEmpty():
        return _plain(df, keys, order, ident, build, carry)
    hot = broadcast_if_small(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    is_hot = _same(keys)
    rest = df.join(hot, is_hot, "left_anti")
    split = df.join(hot, is_hot, "left_semi")
    return _plain(rest, keys, order, ident, build, carry).unionByName(
        _chunked(split, keys, order, ident, back, build, carry, chunk_rows)
    )


def _same(keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_hot_{key}"))
    return condition


def _plain(df, keys, order, ident, build, carry):
    w = Window.partitionBy(*keys).orderBy(order, ident)
    ranked = df.withColumn("_rank", F.row_number().over(w).cast("long"))
    for name, value in carry.items():
        ranked = ranked.withColumn(name, F.lit(None).cast(value.kind))
    return build(ranked, w).drop(*carry)


def _chunked(df, keys, order, ident, back, build, carry, chunk_rows):
    narrow = materialise(df.withColumn("_order", numeric_order(df, order)))
    ranked = group_rank(narrow, keys, "_order", ident, bucket_rows=chunk_rows).drop("_order")
    ranked = ranked.withColumn("_rank", F.col("_rank").cast("long"))
    home = F.floor((F.col("_rank") - 1) / chunk_rows)
    near_end = (F.col("_rank") - 1) % chunk_rows >= chunk_rows - back
    spread = ranked.withColumn("_home", home).withColumn(
        "_chunk",
        F.explode(
            F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
        ),
    )
    if carry:
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = (
            ranked.withColumn("_chunk", home)
            .groupBy(*keys, "_chunk")
            .agg(*[value.column.alias(name) for name, value in carry.items()])
            .select(
                *keys,
                "_chunk",
                *[value.fold(name).over(earlier).cast(value.kind).alias(name) for name, value in carry.items()],
            )
        )
        spread = spread.join(sums, [*keys, "_chunk"])
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rank")
    built = build(spread, w).filter(F.col("_chunk") == F.col("_home"))
    return built.drop("_chunk", "_home", *carry)


def numeric_order(df: DataFrame, column: str) -> Column:
    """The column as a number that sorts alike: microseconds for timestamps."""
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)
