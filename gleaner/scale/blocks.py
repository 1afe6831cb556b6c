"""Rows against a stated set of other rows, block by block.

Some operators compare every row with every member of a set that the caller
states: strategies, classes, reference vectors. Neither side goes into a row or a
plan as a whole. Both are packed into blocks of bounded size, each block of rows
meets each block of members, and numpy works on two tables at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.scale.broadcasts import BROADCAST_BYTES
from gleaner.session import materialise

PACKED = "block bigint, data binary"
SALT = 32


def packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most `rows` neighbouring rows: a number, and the rows as an Arrow stream. No shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(_in_blocks(batches, rows)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_pydict({"block": pa.array([first + k], pa.int64()), "data": [sink.getvalue().to_pybytes()]})

    return df.mapInArrow(of, PACKED)


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1)


Pairs = Iterator[tuple[int, pa.Table, int, pa.Table]]
Work = Callable[[Pairs], Iterator[pd.DataFrame]]


def _in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, waiting = 0, []
    for batch in batches:
        start = 0
        while start < len(batch):
            part = batch.slice(start, rows - held)
            waiting.append(part)
            held, start = held + len(part), start + len(part)
            if held == rows:
                yield pa.Table.from_batches(waiting).combine_chunks()
                held, waiting = 0, []
    if held:
        yield pa.Table.from_batches(waiting).combine_chunks()


def against(
    rows: DataFrame, members: DataFrame, work: Work, schema: str, block_rows: int, member_rows: int,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, merged: str = "",
) -> DataFrame:
    """`work` on (block, rows, block of members, members) for each two blocks, task by task.

    While the members have few bytes, every task gets all their blocks and reads the
    rows as they come. Else blocks of rows and of members are joined over a salt, so that
    few blocks of members are not few hot keys. With `merge`, `work` yields one frame
    for each block of rows that it meets, with a column `block`; the frames of a block are put
    together by `merge`, whose schema is `merged`.
    """
    spark = rows.sparkSession
    sides = materialise(packed(members, member_rows))
    sizes = sides.select("block", F.octet_length("data")).collect()  # a row for each block of members
    if sum(r[1] for r in sizes) <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in sides.select("block", "data").collect()])

        def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = [(n, opened(bytes(data))) for n, data in shared.value]
            first = TaskContext.get().partitionId() << 32

            def pairs() -> Pairs:
                for k, table in enumerate(_in_blocks(batches, block_rows)):
                    for n, some in known:
                        yield first + k, table, n, some

            for frame in work(pairs()):
                yield from pa.Table.from_pandas(merge(frame) if merge else frame, preserve_index=False).to_batches()

        return rows.mapInArrow(in_task, merged if merge else schema)

    numbers = F.array(*[F.lit(r[0]).cast("bigint") for r in sizes])
    each = packed(rows, block_rows).withColumn("_with", F.explode(numbers))
    salted = sides.select(F.col("block").alias("_with"), F.col("data").alias("_members"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    both = each.withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(SALT)).cast("int")).join(salted, ["_with", "_salt"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, pa.Table] = {}  # the last blocks of members, by number

        def pairs() -> Pairs:
            last, table = None, None
            for batch in batches:
                for k in range(len(batch)):
                    block = batch.column(0)[k].as_py()
                    if block != last:
                        last, table = block, opened(batch.column(1)[k].as_py())
                    number = batch.column(2)[k].as_py()
                    if number not in known:
                        if len(known) == 8:
                            known.pop(next(iter(known)))
                        known[number] = opened(batch.column(3)[k].as_py())
                    yield block, table, number, known[number]

        for n, frame in enumerate(work(pairs())):
            if merge:
                frame = frame.assign(_part=(TaskContext.get().partitionId() << 32) + n, _at=np.arange(len(frame)))
            yield from pa.Table.from_pandas(frame, preserve_index=False).to_batches()

    found = both.select("block", "data", "_with", "_members").mapInArrow(joined, schema + ", _part bigint, _at bigint" * bool(merge))
    if not merge:
        return found
    return found.groupBy("block").applyInPandas(lambda frame: merge(frame.sort_values(["_part", "_at"])), merged)


def parts_of(frame: pd.DataFrame) -> Iterator[dict[str, np.ndarray]]:
    """The frames that `merge` gets together, each in the order of the rows of the block."""
    groups = frame.groupby("_part", sort=False) if "_part" in frame else [(0, frame)]
    for _, part in groups:
        yield {c: part[c].to_numpy().copy() for c in part.columns}
