"""Low-rank projection of feature rows and of gradient matrices.

Directions come from frequent directions: each task keeps a sketch of at most
`size` rows, shrunk whenever its buffer is full, and sketches of tasks merge by
being shrunk together, in rounds of `fan_in`. With k of its directions the
squared error of all rows is at most 1 + k / (size - k) times that of the best k
directions, whatever the order of rows and merges. Nothing with dimension times
dimension numbers is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialise

SKETCHES_HELD = 256  # of different keys, in one task


def shrunk(rows: np.ndarray, size: int) -> np.ndarray:
    """At most `size` rows that stand for `rows`: singular values beyond are left out, the squared first of them is subtracted."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    if len(s) > size:
        s, vt = np.sqrt(np.maximum(s[:size] ** 2 - s[size] ** 2, 0.0)), vt[:size]
    live = s > 1e-12 * max(1.0, s[0] if len(s) else 0.0)
    return s[live, None] * vt[live]


class Sketch:
    def __init__(self, size: int):
        self.size, self.parts, self.held = size, [], 0

    def add(self, rows: np.ndarray) -> None:
        for a in range(0, len(rows), 2 * self.size):  # a buffer of twice the size, however many rows come at once
            self.parts.append(rows[a : a + 2 * self.size])
            self.held += len(self.parts[-1])
            if self.held >= 2 * self.size:
                self._shrink()

    def _shrink(self) -> None:
        rows = shrunk(np.concatenate(self.parts), self.size)
        self.parts, self.held = [rows], len(rows)

    def rows(self) -> np.ndarray:
        if self.held > self.size or len(self.parts) > 1:
            self._shrink()
        return self.parts[0] if self.parts else np.empty((0, 0))


def sketches(df: DataFrame, keys: Sequence[str], vector: str, size: int, fan_in: int = 32) -> DataFrame:
    """The keys and `_sketch` (rows of doubles, end to end) of each group's rows. Null vectors are left out."""
    keys = list(keys)
    kinds = dict(df.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "_part int, _sketch binary"

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, open_ = TaskContext.get().partitionId(), {}

        def out() -> pd.DataFrame:
            rows = [(*k, part, s.rows().astype("<f8").tobytes()) for k, s in open_.items()]
            open_.clear()
            return pd.DataFrame(rows, columns=[*keys, "_part", "_sketch"])

        for frame in frames:
            groups = frame.groupby(keys, sort=False, dropna=False) if keys else [((), frame)]
            for key, group in groups:
                key = tuple(key) if isinstance(key, (tuple, list)) else (key,)
                if key not in open_ and len(open_) >= SKETCHES_HELD:
                    yield out()
                open_.setdefault(key, Sketch(size)).add(np.array(group[vector].tolist(), dtype=float))
        if open_:
            yield out()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        sketch = Sketch(size)
        for raw, dimension in zip(frame["_sketch"], frame["_dimension"], strict=True):
            sketch.add(np.frombuffer(raw, dtype="<f8").reshape(-1, dimension))
        first = frame.iloc[:1].drop(columns=["_dimension", "_sketch"])
        return first.assign(_sketch=[sketch.rows().astype("<f8").tobytes()])[[*keys, "_part", "_sketch"]]

    rows = df.filter(F.col(vector).isNotNull()).select(*keys, vector)
    # the widest vector says how the numbers of a sketch fall into rows
    dimension = rows.agg(F.max(F.size(vector))).first()[0] or 1
    found = materialise(rows.mapInPandas(of, schema))
    while True:
        parts = found.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if parts <= 1:
            return found.drop("_part").withColumn("_dimension", F.lit(dimension))
        if parts <= fan_in:
            grouped = found.withColumn("_part", F.lit(0))
        else:
            grouped = found.withColumn("_part", F.pmod(F.xxhash64("_part", F.substring("_sketch", 1, 64)), F.lit(-(-parts // fan_in))).cast("int"))
        found = materialise(grouped.withColumn("_dimension", F.lit(dimension)).groupBy(*keys, "_part").applyInPandas(merge, schema))


def _directions(raw: bytes, dimension: int, rank: int) -> np.ndarray:
    """dimension x rank: the leading right singular vectors of a sketch, filled up to `rank` where the rows span less."""
    rows = np.frombuffer(raw, dtype="<f8").reshape(-1, dimension)
    _, s, vt = np.linalg.svd(rows, full_matrices=False) if len(rows) else (None, np.empty(0), np.empty((0, dimension)))
    found = vt[: min(rank, int((s > 1e-12 * max(1.0, s[0] if len(s) else 0.0)).sum()))].T
    if found.shape[1] < rank:
        found = np.linalg.qr(np.concatenate([found, np.eye(dimension)], axis=1))[0][:, :rank]
    return found


def principal_directions(df: DataFrame, vector: str, rank: int, size: int | None = None) -> np.ndarray:
    """dimension x rank, orthonormal, from one pass over the rows; the driver gets one sketch of `size` rows (4 * rank)."""
    found = sketches(df, [], vector, size or 4 * rank).first()
    return _directions(found["_sketch"], found["_dimension"], rank)


def project(df: DataFrame, vector: str, rank: int, size: int | None = None) -> DataFrame:
    """Adds `projected` (rank numbers), `restored` and the squared `residual`.

    Vectors shorter than twice the rank pass through unchanged. The directions (dimension x rank numbers) go to the tasks.
    """
    dimension = df.select(F.max(F.size(vector))).first()[0] or 0
    if dimension < 2 * rank:
        return (
            df.withColumn("projected", F.col(vector))
            .withColumn("restored", F.col(vector))
            .withColumn("residual", F.lit(0.0))
        )
    shared = df.sparkSession.sparkContext.broadcast(principal_directions(df, vector, rank, size))

    @F.pandas_udf("projected array<double>, restored array<double>, residual double")
    def parts(x: pd.Series) -> pd.DataFrame:
        v = shared.value
        known = x.notna().to_numpy()
        rows = np.array(x[known].tolist(), dtype=float).reshape(-1, len(v))
        low = rows @ v
        back = low @ v.T
        out = pd.DataFrame({"projected": [None] * len(x), "restored": [None] * len(x), "residual": np.nan})
        out.loc[known, "projected"] = pd.Series(list(low), index=out.index[known])
        out.loc[known, "restored"] = pd.Series(list(back), index=out.index[known])
        out.loc[known, "residual"] = ((rows - back) ** 2).sum(axis=1)
        return out

    kept = df.withColumn("_parts", parts(vector))
    return kept.withColumns({c: F.col(f"_parts.{c}") for c in ("projected", "restored", "residual")}).drop("_parts")


def project_matrices(
    df: DataFrame, name: str, step: str, row: str, vector: str, rank: int, gap: int, size: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two-sided projection of a series of matrices, one row of a matrix per row of `df`.

    The factors U and V of a name are taken from its first matrix in every `gap` steps
    and hold until the next: V are leading directions of the rows, U spans the rows' images
    G V. Returns (name, step, core) with core = U^T G V as rank * rank numbers, and the
    rows of U core V^T as (name, step, row, restored, residual).

    No task holds a matrix. V comes from sketches; U follows from the rank x rank
    product (G V)^T (G V), summed over tasks, so each row of U is made from its own row
    of G. A matrix without a row that the refresh step had takes 0 for it in U.
    """
    size = size or 4 * rank
    rows = df.select(name, step, row, vector).withColumn("_seg", F.floor(F.col(step) / gap))
    turns = rows.groupBy(name, "_seg").agg(F.min(F.col(step).cast("bigint")).alias("_turn"))
    rows = rows.join(turns, [name, "_seg"]).drop("_seg")
    source = materialise(rows)
    fresh = source.filter(F.col(step) == F.col("_turn"))
    found = sketches(fresh, [name, "_turn"], vector, size)

    def directions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v = [_directions(raw, d, rank).astype("<f8").tobytes() for raw, d in zip(frame["_sketch"], frame["_dimension"], strict=True)]
            yield frame[[name, "_turn"]].assign(_v=v)

    kinds = dict(rows.dtypes)
    key = f"{name} {kinds[name]}, _turn bigint"
    right = materialise(found.mapInPandas(directions, f"{key}, _v binary"))
    images = source.join(right, [name, "_turn"]).withColumn("_y", _image(rank)(F.col(vector), F.col("_v"))).drop("_v")
    images = materialise(images)
    # (G V)^T (G V) of the refresh steps
    gram = _outer_sums(images.filter(F.col(step) == F.col("_turn")), [name, "_turn"], "_y", "_y", rank, "_gram")
    own = images.filter(F.col(step) == F.col("_turn")).join(gram, [name, "_turn"])
    left = materialise(own.select(name, "_turn", row, _root(rank)(F.col("_y"), F.col("_gram")).alias("_u")))
    both = images.join(left, [name, "_turn", row], "left").withColumn("_u", F.coalesce("_u", F.array_repeat(F.lit(0.0), rank)))
    core = materialise(_outer_sums(both, [name, step, "_turn"], "_u", "_y", rank, "core"))
    placed = both.join(core, [name, step, "_turn"]).join(right, [name, "_turn"])
    restored = placed.withColumn("restored", _restored(rank)(F.col("_u"), F.col("core"), F.col("_v")))
    gone = F.aggregate(F.zip_with(vector, "restored", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return core.drop("_turn"), restored.select(name, step, row, "restored", gone.alias("residual"))


def _outer_sums(df: DataFrame, keys: list[str], left: str, right: str, rank: int, out: str) -> DataFrame:
    """Per group the sum of left^T right over its rows, as rank * rank numbers: summed in tasks first, then row by row of the result."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _i int, _a array<double>"

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, i, a) for k, m in held.items() for i, a in enumerate(m)]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "_i", "_a"])

        for frame in frames:
            for key, group in frame.groupby(keys, sort=False, dropna=False):
                a, b = (np.array(group[c].tolist(), dtype=float) for c in (left, right))
                key = tuple(key)
                held[key] = held[key] + a.T @ b if key in held else a.T @ b
            if len(held) > SKETCHES_HELD:
                yield flush()
        if held:
            yield flush()

    parts = df.select(*keys, *{left, right}).mapInPandas(of, schema)
    rows = parts.groupBy(*keys, "_i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("_a")))).alias("_a"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_a")))  # rank rows of rank numbers
    return rows.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda r: r["_a"])).alias(out))


def _image(rank: int):
    @F.pandas_udf("array<double>")
    def image(x: pd.Series, v: pd.Series) -> pd.Series:
        known = {}
        out = []
        for a, raw in zip(x, v, strict=True):
            if raw not in known:
                known = {raw: np.frombuffer(raw, dtype="<f8").reshape(-1, rank)}
            out.append(np.asarray(a, dtype=float) @ known[raw])
        return pd.Series(out)

    return image


def _root(rank: int):
    @F.pandas_udf("array<double>")
    def root(y: pd.Series, gram: pd.Series) -> pd.Series:
        """Rows of Y (Y^T Y)^(-1/2); directions without weight stay 0."""
        out, last, w = [], None, None
        for a, g in zip(y, gram, strict=True):
            g = np.asarray(g, dtype=float)
            if last is None or not np.array_equal(g, last):
                last = g
                values, vectors = np.linalg.eigh(g.reshape(rank, rank))
                live = values > 1e-14 * max(values.max(), 1e-300)
                w = (vectors[:, live] / np.sqrt(values[live])) @ vectors[:, live].T
            out.append(np.asarray(a, dtype=float) @ w)
        return pd.Series(out)

    return root


def _restored(rank: int):
    @F.pandas_udf("array<double>")
    def restored(u: pd.Series, core: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([
            np.asarray(a, dtype=float) @ np.asarray(c, dtype=float).reshape(rank, rank) @ np.frombuffer(raw, dtype="<f8").reshape(-1, rank).T
            for a, c, raw in zip(u, core, v, strict=True)
        ])

    return restored


def compression_ratio(df: DataFrame, vector: str, rank: int) -> DataFrame:
    """Numbers kept by a rank-r factorisation over numbers stored, and the fixed rank / 1000."""
    n, d = F.count("*").cast("double"), F.max(F.size(vector)).cast("double")
    return df.agg(
        ((n + d) * rank / (n * d)).alias("stored_ratio"), F.lit(rank / 1000.0).alias("nominal_ratio")
    )
