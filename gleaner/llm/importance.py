"""Draws documents that resemble a target, by importance resampling with Gumbel noise.

Texts become runs of 1 to `longest` words, hashed to buckets. A bucket's gain is
the logarithm of its share in the target over its share in all documents, in
thousandths; a document's weight is the sum over its features, looked up in one
array of gains. With Gumbel noise from a hash of the id added, the highest scores
are a sample without replacement whose chances follow the weights.

Texts are read once: the buckets of each document are written to the shared
folder, counted in partial sums, and scored from there. The scores are written as
a narrow table. How many are drawn follows from a count; the score of the last one
is found by bisection, each step an exact count over the written scores, and ties at
it by bisection over the ids. Only then the drawn rows are range-partitioned by score,
sorted within the ranges, and ranked by the sizes of the ranges before them. Nothing
but counts comes to the driver.

Edge cases: a null or empty text has no features and weight 0. A row without id
has no noise: its score and rank are null, and it does not count for the number
drawn. Rows that repeat an id are scored each; ties at the cut beyond the id go to
the row read first. Long texts are rows of a task. An empty table gives no rows; an empty
target has equal shares in all buckets. Only id and text are read, so other columns
cannot clash. Ids are integers.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import long_array, terms_of
from gleaner.llm.tokens import slices
from gleaner.scale import broadcast_if_small
from gleaner.session import materialise

NOISE = 1 << 32
STEPS = 4  # halvings that one count job decides


def hashes(words: list[bytes], longest: int) -> np.ndarray:
    """crc32 of every run of 1 to `longest` words, joined by one space."""
    runs = [words] + [[b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(2, longest + 1)]
    return np.fromiter(map(zlib.crc32, itertools.chain(*runs)), dtype=np.uint32, count=sum(map(len, runs)))


def hashed(documents: DataFrame, ident: str, text: str, longest: int, buckets: int) -> DataFrame:
    """_id, _words (how many) and _b: the buckets of the features, as little-endian numbers of two bytes, or four if they need them."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(rows, "_t"):
            words = [terms_of(t) for t in some.column("_t").cast(pa.binary()).to_pylist()]
            found = [(hashes(w, longest) % buckets).astype(kind).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays(
                [some.column("_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(found, pa.binary())],
                names=["_id", "_words", "_b"],
            )

    source = documents.select(F.col(f"`{ident}`").cast("bigint").alias("_id"), F.col(f"`{text}`").alias("_t"))
    return source.mapInArrow(of, "_id bigint, _words bigint, _b binary")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: one vector a task, then partial sums; at most `buckets` numbers reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for some in slices([batch], "_b"):
                total += np.bincount(np.frombuffer(b"".join(some.column("_b").to_pylist()), dtype=kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    sums = rows.select("_b").mapInArrow(of, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    b = len(corpus)
    all_s, all_t = float(corpus.sum()) + b, float(target.sum()) + b
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in pairs], dtype=np.int64)


def weighted(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """_id, _words, n_features and weight from the array of gains."""
    kind = "<u2" if len(table) <= 1 << 16 else "<u4"
    shared = rows.sparkSession.sparkContext.broadcast(table)  # as long as there are buckets

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "_b", at_most=5000):
            raw = some.column("_b").to_pylist()
            lengths = np.array([len(r) for r in raw]) // np.dtype(kind).itemsize
            values = np.concatenate([[0], shared.value[np.frombuffer(b"".join(raw), dtype=kind)].cumsum()])
            ends = lengths.cumsum()
            yield pa.RecordBatch.from_arrays(
                [some.column("_id"), some.column("_words"), pa.array(lengths, pa.int64()), pa.array(values[ends] - values[ends - lengths], pa.int64())],
                names=["_id", "_words", "n_features", "weight"],
            )

    return rows.mapInArrow(of, "_id bigint, _words bigint, n_features bigint, weight bigint")


def gumbel(ident: Column, seed: int | str) -> Column:
    """Thousandths of a Gumbel number from a hash of the id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(NOISE)
    return F.floor(-1000.0 * F.log(-F.log(uniform)))


def lowest_reaching(rows: DataFrame, value: Column, low: int, high: int, wanted: int) -> tuple[int, int]:
    """The smallest v between the bounds with at least `wanted` rows of value <= v, and how many rows are below v."""
    below = 0  # rows with a value below `low`
    while low < high:
        cuts = sorted({low + (high - low) * j // (1 << STEPS) for j in range(1 << STEPS)})  # each leaves both sides smaller
        counted = rows.agg(*[F.count_if(value <= c).alias(f"c{k}") for k, c in enumerate(cuts)]).first()
        k = next((k for k in range(len(cuts)) if counted[k] >= wanted), len(cuts))
        if k < len(cuts):
            high = cuts[k]
        if k:
            low, below = cuts[k - 1] + 1, counted[k - 1]
    return low, below


def cut(rows: DataFrame, wanted: int) -> Column:
    """Which rows are the `wanted` highest by score, ties to the smaller id and then the smaller `_row`. `rows` is a written table."""
    if not wanted:
        return F.lit(False)
    chosen, tied = F.lit(False), F.lit(True)
    for value in (-F.col("score"), F.col("_id"), F.col("_row")):
        here = rows.filter(tied)
        low, high, n = here.agg(F.min(value), F.max(value), F.count("*")).first()
        if n == wanted:
            break
        at, below = lowest_reaching(here, value, low, high, wanted)
        chosen, tied, wanted = chosen | (tied & (value < at)), tied & (value == at), wanted - below
    return chosen | tied


def ranked(chosen: DataFrame, range_rows: int = 1_000_000) -> DataFrame:
    """`chosen` with its rank by descending score, then id and `_row`: places inside ranges, after the sizes of the ranges before."""
    cores = chosen.sparkSession.sparkContext.defaultParallelism
    rows = chosen.count()
    parts = max(1, -(-rows // range_rows), min(cores, -(-rows // 10_000)))
    order = [F.col("score").desc(), F.col("_id"), F.col("_row")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            yield batch.append_column("_part", pa.array(np.full(n, part, dtype=np.int32))).append_column("_at", pa.array(np.arange(at + 1, at + n + 1)))
            at += n

    kinds = ", ".join(f"{c} {k}" for c, k in chosen.dtypes)
    placed = materialise(
        chosen.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, _part int, _at bigint")
    )
    sizes = dict(placed.groupBy("_part").agg(F.count("*")).collect())  # a number for each range
    before = [0, *itertools.accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    return placed.withColumn("rank", F.col("_at") + F.get(long_array(before), F.col("_part"))).drop("_part", "_at")


def resample(
    documents: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
    buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int | str = 2024,
) -> DataFrame:
    """_id, n_features, weight, score and rank of every document; `percent` of those of `least_words` words are drawn, the others
    have no rank."""
    rows = materialise(hashed(documents, ident, text, longest, buckets))
    wished = bucket_counts(hashed(target.withColumn("_0", F.lit(0)), "_0", target_text, longest, buckets), buckets)
    table = gains(bucket_counts(rows, buckets), wished)
    scored = weighted(rows, table).withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed))
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()))
    may = F.col("score").isNotNull() & (F.col("_words") >= least_words)
    pool = scored.filter(may)
    drawn = may & cut(pool, percent * pool.count() // 100)
    columns = ["_id", "n_features", "weight", "score"]
    with_rank = ranked(scored.filter(drawn).select(*columns, "_row")).select(*columns, "rank")
    return with_rank.union(scored.filter(~drawn).select(*columns, F.lit(None).cast("bigint")))


def drawn_documents(documents: DataFrame, result: DataFrame, ident: str = "doc_id") -> DataFrame:
    """The rows of the documents with a drawn id, whole."""
    ids = materialise(result.filter(F.col("rank").isNotNull()).select(F.col("_id").alias(ident)).distinct())
    return documents.join(broadcast_if_small(ids), ident, "left_semi")
