"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors are rotated by the eigenvectors of their Gram matrix, an aggregate of
dimension x dimension numbers, so their leading coordinates hold most of their
length. They are cut into blocks by descending length. A query block meets the
longest block first, which gives each query a k-th score to beat. Blocks that
no query's length can lift over its k-th score are left out; in the others, a
candidate is dropped as soon as its partial inner product plus the product of
the residual lengths, or at first the product of the whole lengths, stays below.
What survives is scored in integers. Each task reports at most k rows per query.

Ties go to the smaller id, so a bound equal to the k-th score does not prune,
and bounds carry a margin for rounding.

Edge cases: vectors that are null, hold a null or a non-finite component, or have
another length than most take no part; so do rows
without an id. Fewer candidates than k give all. Repeated rows are candidates
each, a row with the query's own id never. An empty table gives no rows. Other
columns are not read. Components must keep the sums within 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import double_array
from gleaner.session import materialise

BLOCK_BYTES = 2_000_000
EXACT = float(1 << 52)


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null if a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(scale * v)))


def _array(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products, by tasks and then on the driver: dim x dim numbers from each task."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for frame in frames:
            if len(frame):
                x = _array(frame["_v"]).astype(float)
                total += x.T @ x
        yield pd.DataFrame({"row": range(dim), "values": list(total)})

    parts = vectors.select("_v").mapInPandas(of, "row int, values array<double>")
    summed = parts.select("row", F.posexplode("values").alias("col", "value")).groupBy("row", "col").agg(F.sum("value").alias("value"))
    out = np.zeros((dim, dim))
    for row, col, value in summed.collect():
        out[row, col] = value
    return out


def rotation(total: np.ndarray) -> np.ndarray:
    """Orthonormal directions by descending energy."""
    values, vectors = np.linalg.eigh(total)
    return vectors[:, np.argsort(-values)]


def search_block(
    queries: tuple[np.ndarray, np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray], turn: np.ndarray, k: int,
    steps: tuple[int, ...], counts: dict[str, int] | None = None,
) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the best k candidates of one block for each query.

    `queries` are ids, vectors and the score that a candidate must reach; `block`
    ids and vectors by descending length.
    """
    q_ids, q, bars = queries
    c_ids, c = block
    q_float, c_float = q.astype(float), c.astype(float)
    q_turned, c_turned = q_float @ turn, c_float @ turn
    q_len, c_len = np.linalg.norm(q_float, axis=1), np.linalg.norm(c_float, axis=1)
    slack = 1e-9 * (q_len.max(initial=0.0) * c_len.max(initial=0.0) + 1.0)
    exact = float(np.abs(q_float).max(initial=0)) * float(np.abs(c_float).max(initial=0)) * q.shape[1] < EXACT
    out = []
    rest_c = {d: np.sqrt(np.maximum((c_turned[:, d:] ** 2).sum(axis=1), 0)) for d in steps}
    for i in range(len(q_ids)):
        bar = bars[i]
        # lengths descend: only a prefix can reach the bar
        if q_len[i] == 0.0:
            last = len(c_ids) if bar <= 0 else 0
        else:
            last = int(np.searchsorted(-c_len, -(bar - slack) / q_len[i], side="right")) if np.isfinite(bar) else len(c_ids)
        alive = np.arange(last)
        partial, done = np.zeros(last), 0
        for d in steps:
            if not len(alive):
                break
            partial = partial + c_turned[alive, done:d] @ q_turned[i, done:d]
            rest_q = float(np.sqrt((q_turned[i, d:] ** 2).sum()))
            if not np.isfinite(bar) and len(alive) > k:
                # no bar yet: the k-th lower bound is one
                lower = partial - rest_c[d][alive] * rest_q
                floor_ = np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1]
                keep = partial + rest_c[d][alive] * rest_q >= floor_ - slack
            else:
                keep = partial + rest_c[d][alive] * rest_q >= bar - slack
            alive, partial, done = alive[keep], partial[keep], d
        if counts is not None:
            counts["scored"] = counts.get("scored", 0) + len(alive)
            counts["pairs"] = counts.get("pairs", 0) + len(c_ids)
        alive = alive[c_ids[alive] != q_ids[i]]
        if len(alive):
            scores = (c_float[alive] @ q_float[i]).astype(np.int64) if exact else c[alive] @ q[i]
            order = np.lexsort((c_ids[alive], -scores))[:k]
            out += [(int(q_ids[i]), int(c_ids[alive[o]]), int(scores[o])) for o in order]
    return out


def _meet(pairs: DataFrame, turn: np.ndarray, k: int, steps: tuple[int, ...]) -> DataFrame:
    """Each row is a query block and a candidate block: packed ids and vectors, and the queries' bars."""
    dim = len(turn)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                queries = (
                    np.frombuffer(row.q_ids, dtype=np.int64), np.frombuffer(row.q_vectors, dtype=np.int64).reshape(-1, dim),
                    np.frombuffer(row.q_bars, dtype=np.float64),
                )
                block = np.frombuffer(row.c_ids, dtype=np.int64), np.frombuffer(row.c_vectors, dtype=np.int64).reshape(-1, dim)
                found = search_block(queries, block, turn, k, steps)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    columns = ["q_ids", "q_vectors", "q_bars", "c_ids", "c_vectors"]
    return pairs.select(*columns).mapInPandas(of, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _packed(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The rows of a block as binaries, longest vector first. `_bar` goes along; `_low` is the least length that can matter."""

    def of(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_len", "_id"], ascending=[False, True], kind="stable")
        bars, lengths = frame["_bar"].to_numpy(float), frame["_len"].to_numpy(float)
        need = np.where(bars > 0, bars / np.maximum(lengths, 1e-300), 0.0)
        return pd.DataFrame({
            **{name: [value] for name, value in zip(keys, key, strict=True)},
            f"{prefix}_ids": [frame["_id"].to_numpy(np.int64).tobytes()], f"{prefix}_vectors": [_array(frame["_v"]).tobytes()],
            f"{prefix}_bars": [bars.tobytes()], "_low": [float(need.min()) * (1 - 1e-9)],
        })

    named = ", ".join(f"{name} bigint" for name in keys)
    schema = f"{named}, {prefix}_ids binary, {prefix}_vectors binary, {prefix}_bars binary, _low double"
    return rows.groupBy(*keys).applyInPandas(of, schema)


def top_inner(
    vectors: DataFrame, is_query: Column, ident: str = "vec_id", vector: str = "embedding", k: int = 5,
    scale: float = 256.0, block_bytes: int = BLOCK_BYTES, max_levels: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query, its own id left out."""
    picked = vectors.select(F.col(ident).cast("bigint").alias("_id"), quantised(F.col(vector), scale).alias("_v"), is_query.alias("_q"))
    sound = picked.filter(F.col("_id").isNotNull() & F.col("_v").isNotNull())
    sizes = sound.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None or not sizes["d"]:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim, total = sizes["d"], sizes["count"]
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    sound = materialise(sound.filter(F.size("_v") == dim).withColumn("_len", length).withColumn("_bar", F.lit(float("-inf"))))
    turn = rotation(gram(sound, dim))
    steps = tuple(sorted({max(1, dim // 4), max(1, dim // 2), dim}))

    # levels by length, the longest first; a level with more rows than a block is dealt to parts by a hash of the id
    rows = max(64, block_bytes // (8 * dim))
    levels = min(max_levels, -(-total // rows))
    bounds = sound.approxQuantile("_len", [i / levels for i in range(1, levels)], 0.1 / levels) if levels > 1 else []
    cuts = sorted(set(bounds), reverse=True)
    level_of = lambda least: (F.size(F.filter(double_array(cuts), lambda c: c > least)) if cuts else F.lit(0)).cast("bigint")
    levelled = sound.withColumn("_level", level_of(F.col("_len")))
    parts = levelled.groupBy("_level").agg(F.ceil(F.count("*") / rows).cast("bigint").alias("_parts"))
    dealt = levelled.join(F.broadcast(parts), "_level").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    candidates = materialise(_packed(dealt, ["_level", "_part"], "c").drop("c_bars", "_low"))

    asked = materialise(sound.filter("_q"))
    query_parts = max(1, -(-asked.count() // max(64, rows // 16)))
    blocked = asked.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(query_parts)))
    longest = candidates.agg(F.min("_level")).scalar()
    opening = _packed(blocked, ["_b"], "q").withColumn("_level", longest).withColumn("_part", F.lit(0).cast("bigint"))
    start = materialise(_best(_meet(opening.join(candidates, ["_level", "_part"]), turn, k, steps), k))

    # the k-th score so far is the bar in the other blocks; a block of queries visits the levels its bars leave open
    reached = start.filter(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").cast("double").alias("_reached"))
    barred = blocked.join(reached, "_id", "left").withColumn("_bar", F.coalesce("_reached", "_bar"))
    queries = materialise(_packed(barred, ["_b"], "q"))
    visits = queries.select("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), level_of(F.col("_low")))).alias("_level"))
    places = candidates.select("_level", "_part").filter((F.col("_level") != longest) | (F.col("_part") != 0))
    pairs = visits.join(places, "_level").join(queries, "_b").join(candidates, ["_level", "_part"])
    rest = _meet(pairs, turn, k, steps)
    best = _best(start.select("query_id", "vec_id", "score").union(rest), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
