"""Exact nearest-neighbour distances without a join of all pairs.

Few reference vectors: they are broadcast and each batch of rows does one
matrix product. Many: rows are grouped around pivots and a row only meets the
groups that the triangle inequality cannot rule out (the pivot partitioning of
Lu et al., "Efficient processing of k nearest neighbor joins using MapReduce",
VLDB 2012). Groups are cut into blocks, so no task holds more than two blocks
however uneven the groups are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.scale import collect_bounded, hash_key
from gleaner.session import materialise

BROADCAST_VECTORS = 20_000
BLOCK_ROWS = 4_096
BLOCK_BYTES = 32_000_000
BLOCKS = 16
PIVOTS = 1_024
PROBES = 256
LONGEST_PATTERN = 48
BROADCAST_BYTES = 64_000_000


def _matrix(column, unit: bool = False) -> np.ndarray:
    """Rows as a matrix, scaled to length 1 if `unit` (a zero vector stays zero)."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if unit else m


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of `a` to all rows of `b`.

    By differences: |a|^2 + |b|^2 - 2ab loses the digits of near vectors.
    """
    if len(b) < len(a):
        return _distances(b, a).T
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        difference = b - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", difference, difference))
    return out


def _nearest(
    rows: np.ndarray, names: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, limits: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the row, place of the point, distance) of the `k` nearest points of each row, nearest first.

    `ids` are in order, and of points at one distance the first ones are taken. A product of single precision gives the
    squared distances up to its rounding error; points within this error of the k-th best are measured by differences of
    the whole numbers, so near vectors keep their digits. Points farther than a row's limit, if there is one, are left out.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    finite = np.isfinite(points).all(axis=1)
    if finite.any():
        # around the points' centre and with lengths of at most 1
        centre = points[finite].mean(axis=0)
        with np.errstate(invalid="ignore", over="ignore"):
            p, rest = (np.where(np.isfinite(m).all(axis=1)[:, None], m - centre, np.nan) for m in (points, rows))
            lengths = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (p, rest)]
        top = max(n[np.isfinite(n)].max(initial=0.0) for n in lengths) or 1.0
        lost = np.finfo(float).eps * max(1.0, np.abs(centre).max() * np.sqrt(len(centre)) / top)
        error = 2 * (points.shape[1] + 8) * np.finfo(np.float32).eps
        squares = (lengths[0] / top) ** 2
        longest = np.sqrt(squares[np.isfinite(squares)].max(initial=0.0))
        widened = np.ascontiguousarray(np.column_stack([p / top, squares]).T, dtype=np.float32)
        step, most = max(1, 4_000_000 // max(1, points.shape[1])), float(np.finfo(np.float32).max) / 2
    for a in range(0, len(rows) if finite.any() else 0, 512):
        q, own = rows[a : a + 512], names[a : a + 512]
        length = lengths[1][a : a + 512] / top
        slack = error * (length + longest) ** 2 + 32 * lost
        # limits of the squared distance without the row's own square
        limit = np.full(len(q), most) if limits is None else np.minimum((limits[a : a + 512] / top) ** 2 + slack - length**2, most)
        twice = np.column_stack([-2 * rest[a : a + 512] / top, np.ones(len(q))]).astype(np.float32)
        i, j, d = found[0]
        for b in range(0, len(points), 2048):
            with np.errstate(invalid="ignore", over="ignore"):
                near = twice @ widened[:, b : b + 2048]
            if exclude_self:
                first, last = (np.searchsorted(ids[b : b + 2048], own, side) for side in ("left", "right"))
                for r in np.flatnonzero(last > first):
                    near[r, first[r] : last[r]] = np.inf
            if near.shape[1] > k and (limit == most).any():
                limit = np.fmin(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)
            r, c = np.divmod(np.flatnonzero((near <= limit.astype(np.float32)[:, None]).ravel()), near.shape[1])
            if not len(r):
                continue
            exact = np.empty(len(r))
            for at in range(0, len(r), step):
                difference = points[c[at : at + step] + b] - q[r[at : at + step]]
                exact[at : at + step] = np.sqrt(np.einsum("ij,ij->i", difference, difference))
            i, j, d = np.concatenate([i, r]), np.concatenate([j, c + b]), np.concatenate([d, exact])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            starts = np.searchsorted(i, np.arange(len(q)))
            best = np.arange(len(i)) - starts[i] < k
            full = np.flatnonzero(np.bincount(i, minlength=len(q)) >= k)
            last = d[starts[full] + k - 1]
            # later points have higher ids: at distance 0 none of them comes in
            limit[full] = np.minimum(limit[full], np.where(last > 0, (last / top) ** 2 + slack[full] - length[full] ** 2, -np.inf))
            i, j, d = i[best], j[best], d[best]
        found.append((i + a, j, d))
    at, place, distance = (np.concatenate(c) for c in zip(*found))
    return at, place, distance


def min_distance(
    rows: DataFrame,
    selected: DataFrame,
    vector: str = "x",
    ident: str = "id",
    out: str = "min_distance",
    unit: bool = False,
) -> DataFrame:
    """Adds the Euclidean distance to the nearest selected vector; null if none is selected.

    With `unit` vectors are scaled to length 1 first; then half the square of
    the distance is 1 - cosine.
    """
    first = selected.select(F.size(vector)).first()
    if first is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    # bounded by bytes: long vectors are broadcast in smaller numbers
    most = max(1, min(BROADCAST_VECTORS, BROADCAST_BYTES // (8 * max(1, first[0] or 1))))
    if selected.select(vector).limit(most + 1).count() > most:
        nearest = knn(rows.select(ident, vector), selected.select(ident, vector), 1, ident, vector, unit=unit)
        best = nearest.groupBy(ident).agg(F.min("distance").alias(out))
        return rows.join(best, ident, "left")
    chosen = _matrix([r[0] for r in collect_bounded(selected.select(vector), most, "selected")], unit)
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    @F.pandas_udf("double")
    def nearest_selected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(_distances(_matrix(v, unit), shared.value).min(axis=1) if len(v) else [])

    return rows.withColumn(out, nearest_selected(vector))


def knn_near(
    rows: DataFrame,
    points: DataFrame,
    k: int,
    ident: str = "id",
    vector: str = "x",
    exclude_self: bool = False,
    unit: bool = False,
    tables: int = 12,
    bucket_rows: int = 512,
    seed: int = 7,
    recall: float = 0.9,
) -> DataFrame:
    """(ident, neighbour, distance) of `k` near points of each row, for sets too large for `knn`.

    Random hyperplanes give each vector a sign pattern in each of `tables` tables;
    a row meets the points with its pattern. Patterns are as long as it takes for
    about `bucket_rows` points in a bucket; a bucket that holds more is cut further
    by the next signs, and by a hash of the point's id once the signs are used up,
    so a task never holds more than a few times `bucket_rows` points and the work
    is rows x tables x bucket_rows. Distances are exact. A near point is missed if
    no table puts it in the row's bucket.

    How many are missed depends on the vectors, so it is measured: the exact neighbours
    of `PROBES` rows are looked up in the buckets, which grow until `recall` of them are
    found, two standard errors included. Vectors without groups need buckets that come
    to all points over the tables; they go to `knn`, which then costs less.
    """
    total = points.count()
    dim = (points.select(F.size(vector)).first() or [0])[0]
    if not total or not dim:
        return rows.select(ident, F.col(ident).alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    spark = rows.sparkSession
    planes = np.random.default_rng(seed).normal(size=(tables, LONGEST_PATTERN, dim))
    shared = spark.sparkContext.broadcast(planes)
    weights = 1 << np.arange(LONGEST_PATTERN - 1, -1, -1, dtype=np.int64)

    def pattern(x: np.ndarray, flat: np.ndarray) -> np.ndarray:
        return ((x @ flat.T > 0).reshape(len(x), tables, -1) * weights).sum(axis=2)

    @F.pandas_udf("array<bigint>")
    def patterns(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flat = shared.value.reshape(-1, dim)
        for v in batches:
            yield pd.Series(list(pattern(_matrix(v, unit), flat))) if len(v) else pd.Series([], dtype=object)

    def enough(share: float, probed: int) -> bool:
        return share - 2 * math.sqrt(share * (1 - share) / max(1, probed)) >= recall

    # signs of the probed rows and of their nearest points, (pair, table)
    probes = materialise(rows.select(ident, vector).orderBy(hash_key(ident, "probe"), ident).limit(PROBES))
    nearest = materialise(knn(probes, points.select(ident, vector), k, ident, vector, exclude_self, unit))
    there = points.select(F.col(ident).alias("neighbour"), F.col(vector).alias("_there"))
    pairs = nearest.join(probes, ident).join(F.broadcast(nearest.select("neighbour").distinct()).join(there, "neighbour"), "neighbour")
    drawn = collect_bounded(pairs.select(ident, vector, "_there"), 4 * k * PROBES, "probed pairs")
    probed = len({r[0] for r in drawn})
    here, away = (pattern(_matrix([r[c] for r in drawn], unit), planes.reshape(-1, dim)) if drawn else np.empty((0, tables), np.int64) for c in (1, 2))

    def length_for(size: int) -> int:
        return min(LONGEST_PATTERN, max(0, math.ceil(math.log2(total / size))) if total > size else 0)

    def together(bits: int) -> float:
        """Share of the pairs that uncut buckets bring together; cuts can only lower it."""
        return float(((here ^ away) >> (LONGEST_PATTERN - bits) == 0).any(axis=1).mean()) if len(here) else 1.0

    def signed(df: DataFrame) -> DataFrame:
        return materialise(df.select(F.col(ident).alias("_id"), F.col(vector).alias("_x"), patterns(vector).alias("_p")))

    place = lambda n: F.shiftright("_sign", LONGEST_PATTERN - n)
    keys, members = ["_t", "_length", "_b"], None
    while True:
        bits = length_for(bucket_rows)
        if bits and tables * bucket_rows >= total and not enough(together(bits), probed):
            return knn(rows, points, k, ident, vector, exclude_self, unit)
        if not enough(together(bits), probed):
            bucket_rows *= 2
            continue
        if members is None:
            members = signed(points)
            signs = materialise(members.select(F.posexplode("_p").alias("_t", "_sign")))
        cuts = _cuts(signs, bits, bucket_rows, place)
        lengths = [n for n in range(bits, LONGEST_PATTERN + 1) if n == bits or (n - bits) % 4 == 0 or n == LONGEST_PATTERN]
        options = F.explode(F.array(*[F.struct(F.lit(n).alias("_length"), place(n).alias("_b")) for n in lengths]))
        if not bits or not len(here):
            break
        flat = [(p, t, s, int(x[p, t])) for s, x in enumerate((here, away)) for p in range(len(here)) for t in range(tables)]
        met = spark.createDataFrame(flat, "_pair int, _t int, _s int, _sign long").withColumn("_o", options).select("_pair", "_t", "_s", "_o.*")
        both = F.broadcast(met).join(cuts, keys).groupBy("_pair", *keys).agg(F.count_distinct("_s").alias("_sides")).filter("_sides = 2")
        if enough(both.agg(F.count_distinct("_pair")).first()[0] / len(here), probed):
            break
        if tables * bucket_rows >= total:
            return knn(rows, points, k, ident, vector, exclude_self, unit)
        bucket_rows *= 2
    left = members if rows is points else signed(rows)

    each = lambda df: df.select("_id", "_x", F.posexplode("_p").alias("_t", "_sign"))
    placed = lambda df: each(df).withColumn("_o", options).select("_id", "_x", "_t", "_o.*").join(cuts.select(*keys, "_parts"), keys)
    own = placed(members).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).withColumn("_side", F.lit(1))
    ask = placed(left).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_side", F.lit(0))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["_side"] == 0], frame[frame["_side"] == 1].sort_values("_id")
        if not len(a) or not len(b):
            return pd.DataFrame({ident: [], "neighbour": [], "distance": []})
        names, ids = a["_id"].to_numpy(), b["_id"].to_numpy()
        at, near, distance = _nearest(_matrix(a["_x"], unit), names, _matrix(b["_x"], unit), ids, k, exclude_self)
        return pd.DataFrame({ident: names[at], "neighbour": ids[near], "distance": distance})

    kind = dict(rows.dtypes)[ident]
    columns = ["_t", "_length", "_b", "_part", "_side", "_id", "_x"]
    met = own.select(*columns).union(ask.select(*columns)).groupBy("_t", "_length", "_b", "_part")
    # a pair may be measured in several tables; its digits can differ in the last place
    found = met.applyInPandas(meet, f"{ident} {kind}, neighbour {kind}, distance double").groupBy(ident, "neighbour").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy(ident).orderBy("distance", "neighbour")
    return found.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k).drop("_at")


def _cuts(signs: DataFrame, bits: int, bucket_rows: int, place) -> DataFrame:
    """(_t, _length, _b, _n, _parts): the length of the pattern, bucket by bucket; only buckets that are too full are looked at again."""
    cuts, full, length = None, signs, bits
    while True:
        sizes = full.groupBy("_t", place(length).alias("_b")).agg(F.count("*").alias("_n"))
        last = length >= LONGEST_PATTERN
        done = (sizes if last else sizes.filter(F.col("_n") <= 2 * bucket_rows)).withColumn("_length", F.lit(length))
        cuts = done if cuts is None else cuts.union(done)
        over = materialise(sizes.filter(F.col("_n") > 2 * bucket_rows).select("_t", "_b"))
        if last or over.isEmpty():
            break
        full = full.withColumn("_b", place(length)).join(over, ["_t", "_b"], "left_semi").drop("_b")
        length = min(LONGEST_PATTERN, length + 4)
    return materialise(cuts.withColumn("_parts", F.ceil(F.col("_n") / (2 * bucket_rows)).cast("int")))


def knn(
    rows: DataFrame,
    points: DataFrame,
    k: int,
    ident: str = "id",
    vector: str = "x",
    exclude_self: bool = False,
    unit: bool = False,
    pivots: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """(ident, neighbour, distance) of the `k` nearest points of each row, exact.

    1. Pivots are a hash-ordered draw; every row and point joins its nearest one.
    2. Rows meet the points of their own group: the k-th distance found is a bound.
    3. A row visits another group only if neither the group's radius nor the
       plane halfway between the two pivots shows all its points to be farther.
    4. Rows and points meet block by block; the winners of the blocks merge.

    Vectors without groups rule out little and every two blocks meet, so rows travel
    once for each block of points. There are about `BLOCKS` blocks, or more where
    one of them would go beyond `BLOCK_BYTES`: what travels grows with the rows up
    to `BLOCKS * BLOCK_BYTES` of points, the distances with the square.
    """
    total, width = points.agg(F.count("*"), F.max(F.size(vector))).first()
    if block_rows is None:
        block_rows = max(1, min(BLOCK_BYTES // (8 * max(1, width or 1)), max(BLOCK_ROWS, math.ceil(total / BLOCKS))))
    if pivots is None:
        pivots = max(1, min(PIVOTS, math.ceil(total / block_rows)))
    drawn = points.orderBy(hash_key(ident, "pivot"), ident).limit(pivots)
    centres = _matrix([r[0] for r in collect_bounded(drawn.select(vector), pivots, "pivots")], unit)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cell:int,r:double>")
    def nearest_pivot(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            d = _distances(_matrix(v, unit), shared.value) if len(v) else np.empty((0, 1))
            yield pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "r": d.min(axis=1)})

    def assigned(df: DataFrame) -> DataFrame:
        near = df.select(F.col(ident).alias("_id"), F.col(vector).alias("_x"), nearest_pivot(vector).alias("_p"))
        return materialise(near.select("_id", "_x", F.col("_p.cell").alias("_cell"), F.col("_p.r").alias("_r")))

    members = assigned(points)
    left = members if rows is points else assigned(rows)
    stats = members.groupBy("_cell").agg(F.max("_r").alias("radius"), F.count("*").alias("size"))
    groups = {r["_cell"]: r for r in collect_bounded(stats, pivots, "pivot groups")}
    blocks = [math.ceil(groups[c]["size"] / block_rows) if c in groups else 0 for c in range(len(centres))]
    meet = _BlockJoin(members, blocks, block_rows, k, exclude_self, unit)

    own = meet.join(left.select("_id", "_x", "_cell", F.lit(float("inf")).alias("_limit")))
    if len(groups) == 1:
        found = own
    else:
        own = materialise(_merge(own, k))
        bound = own.groupBy("_id").agg(
            F.when(F.count("*") == k, F.max("distance")).alias("_bound")
        )
        radius = np.array([groups[c]["radius"] if c in groups else -np.inf for c in range(len(centres))])
        plan = rows.sparkSession.sparkContext.broadcast((radius, _distances(centres, centres)))

        @F.pandas_udf("array<int>")
        def others(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            radii, between = plan.value
            for x, home, bounds in batches:
                out = []
                d = _distances(_matrix(x, unit), shared.value) if len(x) else []
                for at, cell, limit in zip(d, home, bounds.fillna(np.inf)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (at**2 - at[cell] ** 2) / (2 * between[cell])
                    plane = np.where(between[cell] > 0, plane, -np.inf)
                    far = np.maximum(at - radii, plane) > limit + 1e-9
                    visit = np.isfinite(radii) & ~far
                    visit[cell] = False
                    out.append(np.flatnonzero(visit).astype("int32"))
                yield pd.Series(out)

        limited = left.join(bound, "_id", "left").withColumn("_others", others("_x", "_cell", "_bound"))
        limit = F.coalesce("_bound", F.lit(float("inf"))).alias("_limit")
        visits = materialise(limited.select("_id", "_x", limit, "_others"))
        found = own.unionByName(meet.join(visits.select("_id", "_x", F.explode("_others").alias("_cell"), "_limit")))
    return _merge(found, k).select(F.col("_id").alias(ident), "neighbour", "distance")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all candidates; Spark keeps k per task before the shuffle."""
    best = Window.partitionBy("_id").orderBy("distance", "neighbour")
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


class _BlockJoin:
    """Nearest points of rows inside given groups, in tasks of at most two blocks."""

    def __init__(self, members, blocks: list[int], block_rows: int, k: int, exclude_self: bool, unit: bool):
        self.counts = F.get(F.array(*[F.lit(b) for b in blocks]), F.col("_cell"))
        self.points = members.select(
            "_cell", F.pmod(F.xxhash64("_id"), self.counts).cast("int").alias("_block"), "_id", "_x"
        )
        self.block_rows, self.k, self.exclude_self, self.unit = block_rows, k, exclude_self, unit

    def join(self, visits: DataFrame) -> DataFrame:
        place = ["_cell", "_block", "_part"]
        reach = visits.filter(self.counts > 0).select(
            "_id", "_x", "_limit", "_cell", F.explode(F.sequence(F.lit(0), self.counts - 1)).alias("_block")
        )
        # Rows that visit a block are cut into parts; the points of the block go to each part.
        # A row for each block: broadcast, as a join on so few keys would put all rows in few tasks.
        load = F.broadcast(reach.groupBy("_cell", "_block").agg(
            F.ceil(F.count("*") / self.block_rows).cast("int").alias("_parts")
        ))
        queries = reach.join(load, ["_cell", "_block"]).withColumn(
            "_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")
        )
        targets = self.points.join(load, ["_cell", "_block"]).withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        )
        # New names: rows and points may come from the same frame.
        aside = targets.select(*[F.col(c).alias(f"_t{c}") for c in ("_id", "_x", *place)])
        return (
            queries.select("_id", "_x", "_limit", *place)
            .groupBy(*place)
            .cogroup(aside.groupBy(*[f"_t{c}" for c in place]))
            .applyInPandas(
                _nearest_in_block(self.k, self.exclude_self, self.unit),
                "_id long, neighbour long, distance double",
            )
        )


def _nearest_in_block(k: int, exclude_self: bool, unit: bool):
    def nearest(queries: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(targets):
            return pd.DataFrame({"_id": [], "neighbour": [], "distance": []})
        names, ids = queries["_id"].to_numpy(), targets["_t_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], _matrix(targets["_t_x"], unit)[order]
        at, near, distance = _nearest(_matrix(queries["_x"], unit), names, points, ids, k, exclude_self, queries["_limit"].to_numpy(float))
        return pd.DataFrame({"_id": names[at], "neighbour": ids[near], "distance": distance})

    return nearest


def knn_diversity(df: DataFrame, ident: str = "id", vector: str = "x", k: int = 5, **options) -> DataFrame:
    """(ident, diversity): mean distance of the unit vectors to the `min(k, n - 1)` nearest others."""
    near = knn(df, df, k, ident, vector, exclude_self=True, unit=True, **options)
    means = near.groupBy(ident).agg(F.avg("distance").alias("diversity"))
    return df.select(ident).join(means, ident, "left").na.fill(0.0, ["diversity"])
