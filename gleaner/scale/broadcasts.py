"""Broadcasts and driver reads behind a check of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return 8 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, StructType):
        return sum((value_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType, MapType)):
            each = F.transform(value, lambda x: value_bytes(x, kind.elementType).cast("bigint"))
            return 8 + F.coalesce(F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))
        return 8 + 8 * F.coalesce(F.size(value), F.lit(0))
    if isinstance(kind, MapType):
        return value_bytes(F.map_keys(value), ArrayType(kind.keyType)) + value_bytes(F.map_values(value), ArrayType(kind.valueType))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`broadcast(df)` if it has at most `max_rows` rows and about `max_bytes`, else `df` for a shuffle join."""
    size = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    if rows <= max_rows and (total or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Rows of a frame that must be small; raises instead of reading more than `max_rows`."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
