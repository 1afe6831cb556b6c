"""Near-duplicates by SetSketch registers: banded, estimated by their joint likelihood, verified on full sets.

A document's set is its distinct five-word shingles. Each shingle is a stream of
points of a Poisson process, dealt to registers at random, so a register's
first point is exponential for each shingle and registers are independent. A
register keeps floor(1 - log_b(x)) of the smallest point it got, truncated to 16
bits: sketches of parts merge by their maximum.

Documents with equal sets are one class, found by a fingerprint with partial
aggregation. Class representatives that agree in a band are candidates. In a
band's bucket everybody is compared with one leader, not with everybody; what
is linked then counts as one component. Only buckets that still hold several
components are compared further; `leader_rounds` lets large ones meet more
leaders first. What is apart is compared across components: all pairs of small buckets, and for members of large ones the pairs that share one
of their rarest shingles (an exact prefix filter). Where even such a shingle is
frequent, blocks of members meet in tasks and report only confirmed pairs. So no link
between components is lost to a size limit, and groups of copies never expand
into pairs. A candidate is dropped when its sizes rule it out, or when the
likelihood estimate lies six standard errors below the threshold; the others are
confirmed on their full sets.

With 64 bands of 6 registers a pair at similarity 0.75 shares no band with
probability 3.6e-6, at 0.8 with 4e-9.

Edge cases: null or empty text, or text without words, gives an empty set that
is linked with nothing. Fewer than five words are one shingle. Long texts are
one row; their points are made in bounded slices. A row without id is returned
unlinked and kept. Where ids repeat, rows are numbered in a written copy and linked
one by one, so each has its own links; `kept` then tells the rows with the
component's id, and `keep_first` leaves one row of each component. Ties go to the
smallest id. An empty table gives no rows; other columns, whatever their names, are
kept by `keep_first`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import release
from gleaner.llm.tokens import batches, slices
from gleaner.scale import broadcast_if_small
from gleaner.session import materialise

WORDS = 5
BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
TOP = 65_535
SLICE = 200_000  # points made at a time
CACHE_WORDS = 150_000
CELLS = 1 << 26  # bits of the bitmap of bucket keys, a multiple of 32768
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. bytes.split parts at exactly the blanks of the word rule."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_known) > CACHE_WORDS:
        _known.clear()
    hashes = []
    for w in words:
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums of a set."""
    if not len(hashes):
        return 0, 0
    a, b = mix(hashes + np.uint64(0x1234567)), mix(hashes ^ np.uint64(0xABCDEF987654321))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int(b.sum(dtype=np.uint64).astype(np.int64))


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers of several sets, one row each. A shingle is dropped once its next point cannot raise any register."""
    sketch = np.zeros((len(sets), m), dtype=np.int32)
    flat, log_base = sketch.ravel(), math.log(BASE)
    h = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x, step = np.zeros(len(h)), 0
    golden = 0x9E3779B97F4A7C15
    while len(h):
        each = int(max(1, min(32, SLICE // len(h))))
        keep_h, keep_at, keep_x = [], [], []
        low = sketch.min(axis=1)
        for a in range(0, len(h), SLICE):
            hs, ats, xs = h[a : a + SLICE], at[a : a + SLICE], x[a : a + SLICE]
            for j in range(each):
                u = mix(hs + np.uint64(golden * (step + j + 1) & 0xFFFFFFFFFFFFFFFF))
                # the upper 40 bits make the gap, the lower 24 choose the register
                gap = -np.log(((u >> np.uint64(24)).astype(np.float64) + 0.5) / float(1 << 40))
                xs = xs + gap / (RATE * m)
                value = np.clip(np.floor(1.0 - np.log(xs) / log_base), 0, TOP).astype(np.int32)
                live = value > low[ats]
                if not live.all():
                    hs, ats, xs, value, u = hs[live], ats[live], xs[live], value[live], u[live]
                    if not len(hs):
                        break
                place = ((u & np.uint64(0xFFFFFF)) % np.uint64(m)).astype(np.int64)
                np.maximum.at(flat, ats * m + place, value)
            keep_h.append(hs), keep_at.append(ats), keep_x.append(xs)
        h, at, x = np.concatenate(keep_h), np.concatenate(keep_at), np.concatenate(keep_x)
        step += each
        if len(h):
            low = sketch.min(axis=1)
            value = np.floor(1.0 - np.log(x) / log_base)
            live = value > low[at]
            h, at, x = h[live], at[live], x[live]
    return sketch.astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per sketch and band."""
    n, m = sketches.shape
    parts = sketches.reshape(n, bands, m // bands).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (n, bands)).copy()
    for j in range(parts.shape[2]):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, :, j])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of each pair of rows by maximum joint likelihood of the register orders, set sizes known.

    The likelihood is concave between 0 and the size ratio; a golden-section
    search runs over all pairs at once.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1.0) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(np.maximum(u - v * j, 1e-12)), p(np.maximum(v - u * j, 1e-12))
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1.0 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (math.sqrt(5.0) - 1.0) / 2.0
    for _ in range(40):
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(c) >= likelihood(d)
        high, low = np.where(left, d, high), np.where(left, low, c)
    return (low + high) / 2.0


def _bar(threshold: float, m: int) -> float:
    return threshold - 6.0 * math.sqrt(threshold * (1.0 - threshold) / m)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), -1)


def sketch(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _n (set size), _f1, _f2 (fingerprint), _regs (registers, little-endian 16-bit)."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(rows, "_t", most=1_000_000):
            sets = [shingles(t) for t in some.column("_t").to_pylist()]
            regs = registers(sets).astype("<u2")
            prints = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([f for f, _ in prints], pa.int64()),
                    pa.array([f for _, f in prints], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                names=["_id", "_n", "_f1", "_f2", "_regs"],
            )

    source = documents.select(F.col(ident).cast("bigint").alias("_id"), F.col(text).alias("_t"))
    return source.mapInArrow(of, "_id bigint, _n bigint, _f1 bigint, _f2 bigint, _regs binary")


def _bands(reps: DataFrame, held: Broadcast | None = None) -> DataFrame:
    """A row per band and representative; with the bitmap `held` those whose key may have a bucket."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 2000):
                some = frame.iloc[a : a + 2000]
                keys = band_keys(_matrix(some["_regs"]))
                at = np.ones(keys.shape, dtype=bool) if held is None else _in_cells(held.value, keys)
                rows = np.nonzero(at)[0]
                yield pd.DataFrame({"_key": keys[at], "_id": some["_id"].to_numpy()[rows], "_n": some["_n"].to_numpy()[rows]})

    return reps.select("_id", "_n", "_regs").mapInPandas(of, "_key bigint, _id bigint, _n bigint")


def _cells(buckets: DataFrame, cells: int = CELLS) -> Broadcast:
    """A bitmap of the buckets' keys. Most bands are alone with their key, so they need not travel to find their bucket.

    Its size is fixed: the more buckets there are, the more bands go along that have none, and the join drops those.
    """
    cell = F.col("_key").bitwiseAND(F.lit(cells - 1)) + 1
    parts = buckets.groupBy(F.bitmap_bucket_number(cell).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    bits = np.zeros((cells >> 15, 4096), dtype=np.uint8)
    for part, some in parts.collect():
        bits[part - 1] = np.frombuffer(some, dtype=np.uint8)
    return buckets.sparkSession.sparkContext.broadcast(bits.ravel())


def _in_cells(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.int64(8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _size_ok(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (_a, _b) whose estimate is not clearly below the threshold."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 4000):
                some = frame.iloc[a : a + 4000]
                guess = estimate(
                    _matrix(some["_ra"]), _matrix(some["_rb"]), some["_na"].to_numpy(float), some["_nb"].to_numpy(float)
                )
                yield some.loc[guess >= _bar(threshold, REGISTERS), ["_a", "_b"]]

    side = lambda x: reps.select(F.col("_id").alias(f"_{x}"), F.col("_n").alias(f"_n{x}"), F.col("_regs").alias(f"_r{x}"))
    both = pairs.join(side("a"), "_a").join(side("b"), "_b")
    return both.mapInPandas(of, "_a bigint, _b bigint")


def _verify(pairs: DataFrame, documents: DataFrame, ident: str, text: str, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold. Sets are made anew from the texts of the documents that occur in pairs."""
    wanted = pairs.select(F.col("_a").alias("_id")).union(pairs.select(F.col("_b").alias("_id"))).distinct()

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["_t"].tolist()
            for a, b in batches([len(t) if t else 0 for t in texts], most=1_000_000):
                yield pd.DataFrame({"_id": frame["_id"].iloc[a:b], "_set": [shingles(t).tobytes() for t in texts[a:b]]})

    def confirmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["_sa"], frame["_sb"], strict=True):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield frame.loc[keep, ["_a", "_b"]]

    source = documents.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("_id"), F.col(text).alias("_t"))
    found = source.join(broadcast_if_small(materialise(wanted)), "_id", "left_semi")
    sets = materialise(found.mapInPandas(sets_of, "_id bigint, _set binary"))
    side = lambda x: sets.select(F.col("_id").alias(f"_{x}"), F.col("_set").alias(f"_s{x}"))
    return pairs.join(side("a"), "_a").join(side("b"), "_b").mapInPandas(confirmed, "_a bigint, _b bigint")


def components(links: DataFrame) -> DataFrame:
    """(_id, _label): the smallest id of each linked id's component.

    Large and small stars in turn: every edge is moved to the smallest neighbour
    known, until all edges point at a common end. The minima are partial aggregates,
    and they are joined back by broadcast while few, so a hub with many neighbours
    is no hot task.
    """
    edges = materialise(
        links.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).filter("_u <> _v").distinct()
    )
    while True:  # the rounds grow with the square of the logarithm of the longest chain at most
        # stars already: every id has one end, and no end has an end of its own
        ends = edges.groupBy("_u").agg(F.count("*").alias("n"))
        inner = edges.select(F.col("_v").alias("_u")).distinct().join(edges.select("_u").distinct(), "_u", "left_semi")
        if ends.filter("n > 1").isEmpty() and inner.isEmpty():
            return edges.select(F.col("_u").alias("_id"), F.col("_v").alias("_label"))
        both = edges.union(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        lowest = materialise(both.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m")))
        large = both.join(broadcast_if_small(lowest), "_u").filter("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        large = materialise(large.filter("_u <> _v").distinct())
        down = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        moved = large.join(broadcast_if_small(materialise(down)), "_u")
        pairs = F.array(
            F.when(F.col("_v") != F.col("_m"), F.struct(F.col("_v").alias("_u"), F.col("_m").alias("_v"))),
            F.struct(F.col("_u"), F.col("_m").alias("_v")),
        )
        edges = materialise(moved.select(F.inline(F.filter(pairs, lambda p: p.isNotNull()))).distinct())
        release(links.sparkSession)


def _blocks(large: DataFrame, prefixes: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links between components inside long lists, by the full sets.

    The members of a list are dealt by a hash into blocks of about `block_bytes`, and
    each two blocks meet in one task. Shared shingles are counted for one member
    against all by an index of the block's shingles, and pairs that are connected by
    then are passed over. A pair that meets in several lists is looked at in the
    one of its smallest common key.
    """
    parts = large.groupBy("_key").agg(F.ceil(F.sum(100 + 10 * F.col("_n")) / block_bytes).cast("int").alias("_parts"))
    dealt = large.select("_key", "_id").join(broadcast_if_small(materialise(parts)), "_key")
    own = F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")
    placed = dealt.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    placed = placed.select("_key", "_id", "_own", F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"))

    def index(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, rows = np.concatenate(values), np.repeat(np.arange(len(values)), [len(v) for v in values])
        order = np.argsort(flat, kind="stable")
        return flat[order], rows[order]

    def holders(of: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
        """Rows that hold each of the values, end to end."""
        flat, rows = of
        low, high = np.searchsorted(flat, values), np.searchsorted(flat, values, side="right")
        return np.concatenate([rows[x:y] for x, y in zip(low, high, strict=True)]) if len(values) else rows[:0]

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_id", ignore_index=True)
        ids, n = frame["_id"].to_numpy(), frame["_n"].to_numpy()
        labels, own = frame["_label"].to_numpy(), frame["_own"].to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["_set"]]
        smaller = [np.asarray(x)[np.asarray(x) < key[0]] for x in frame["_keys"]]
        by_shingle, by_key = index(sets), index(smaller)
        parent = {int(x): int(x) for x in set(labels.tolist())}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        # everybody outside the largest component meets all; inside it there is nothing to find
        names, sizes = np.unique(labels, return_counts=True)
        largest, out = labels == names[sizes.argmax()], []
        for k in np.flatnonzero(~largest):
            ok = (labels != labels[k]) & (largest | (ids > ids[k]))
            if key[1] != key[2]:
                ok &= own != own[k]
            ok[holders(by_key, smaller[k])] = False
            shared = np.bincount(holders(by_shingle, sets[k]), minlength=len(ids))
            ok &= 100 * shared >= percent * (n + n[k] - shared)
            for y in np.flatnonzero(ok):
                p, q = root(int(labels[k])), root(int(labels[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((min(ids[k], ids[y]), max(ids[k], ids[y])))
        return pd.DataFrame(out, columns=["_a", "_b"])

    wide = placed.join(prefixes.select("_id", "_n", "_label", "_set", "_keys"), "_id")
    return wide.groupBy("_key", "_i", "_j").applyInPandas(meet, "_a bigint, _b bigint").distinct()


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, without the first leader, of buckets that hold more than one component; `_c` is their number in the bucket."""
    named = members.join(broadcast_if_small(labels), "_id", "left").withColumn("_label", F.coalesce("_label", "_id"))
    return _mixed(named.filter("_size > 2 and _id <> _leader").select("_key", "_id", "_n", "_label"))


def _mixed(inner: DataFrame) -> DataFrame:
    """Rows whose key holds more than one component."""
    mixed = inner.groupBy("_key").agg(F.min("_label").alias("_x"), F.max("_label").alias("_y"), F.count("*").alias("_c")).filter("_x <> _y")
    return materialise(inner.join(broadcast_if_small(materialise(mixed.select("_key", "_c"))), "_key"))


def _across(parts: list[DataFrame], percent: int) -> DataFrame:
    """Distinct pairs (_a, _b) of one key and different components whose sizes allow a link."""
    out = None
    for rows in parts:
        side = lambda x, rows=rows: rows.select("_key", F.col("_id").alias(f"_{x}"), F.col("_n").alias(f"_n{x}"), F.col("_label").alias(f"_l{x}"))
        both = side("a").join(side("b"), "_key").filter((F.col("_a") < F.col("_b")) & (F.col("_la") != F.col("_lb")) & _size_ok("_na", "_nb", percent))
        out = both.select("_a", "_b") if out is None else out.union(both.select("_a", "_b"))
    return out.distinct()


def _prefixes(
    ids: DataFrame, documents: DataFrame, ident: str, text: str, percent: int, cells: int = 1 << 18
) -> DataFrame:
    """The rarest shingles of each document: as many as two sets at the threshold must share one of.

    Any order of all shingles makes this exact. Rarity is counted in a fixed number of
    cells, so the order is one small array; a shingle that shares its cell with a
    frequent one only comes later than it could.
    """

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in batches([len(t) if t else 0 for t in frame["_t"]], most=1_000_000):
                some = frame.iloc[a:b]
                yield some.drop(columns=["_t"]).assign(_set=[shingles(t).tobytes() for t in some["_t"]])

    source = documents.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("_id"), F.col(text).alias("_t"))
    chosen = source.join(broadcast_if_small(materialise(ids)), "_id").select("_id", "_n", "_label", "_t")
    sets = materialise(chosen.mapInPandas(sets_of, "_id bigint, _n bigint, _label bigint, _set binary"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, dtype=np.int64)
        for frame in frames:
            for s in frame["_set"]:
                np.add.at(total, (np.frombuffer(s, dtype=np.uint64) % np.uint64(cells)).astype(np.int64), 1)
        places = np.flatnonzero(total)
        yield pd.DataFrame({"cell": places, "n": total[places]})

    summed = sets.select("_set").mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    order = np.zeros(cells, dtype=np.int64)
    for cell, n in summed.collect():
        order[cell] = n
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def rarest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in batches([len(s) for s in frame["_set"]], most=2_000_000):
                some, keys = frame.iloc[a:b], []
                for s in some["_set"]:
                    h = np.frombuffer(s, dtype=np.uint64)
                    by = np.lexsort((h, shared.value[(h % np.uint64(cells)).astype(np.int64)]))
                    keys.append(h[by[: len(h) - -(-percent * len(h) // 100) + 1]].view(np.int64))
                yield some.assign(_keys=keys)

    return materialise(sets.mapInPandas(rarest, "_id bigint, _n bigint, _label bigint, _set binary, _keys array<bigint>"))


def _linked(
    documents: DataFrame, sketched: DataFrame, ident: str, text: str, percent: int, small_bucket: int = 8, short_list: int = 48,
    block_bytes: int = 16_000_000, leader_rounds: int = 0,
) -> DataFrame:
    """_id, n_shingles and component_id of rows with unique ids. `sketched` is their written `sketch`."""
    threshold, spark = percent / 100, documents.sparkSession
    full = sketched.filter("_n > 0")
    prints = ["_f1", "_f2", "_n"]
    classes = materialise(
        full.groupBy(*prints).agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies")).filter("_copies > 1").drop("_copies")
    )
    classed = full.join(broadcast_if_small(classes), prints, "left").withColumn("_rep", F.coalesce("_rep", "_id"))
    reps = materialise(classed.filter("_id = _rep").select("_id", "_n", "_regs"))

    buckets = _bands(reps).groupBy("_key").agg(F.min("_id").alias("_leader"), F.count("*").alias("_size")).filter("_size > 1")
    buckets = materialise(buckets)
    members = materialise(_bands(reps, _cells(buckets)).join(broadcast_if_small(buckets), "_key"))
    del buckets
    release(spark)
    # sizes rule out most chance pairs before any register is shuffled
    lead_sizes = members.filter("_id = _leader").select("_leader", F.col("_n").alias("_m")).distinct()
    led = members.filter("_id <> _leader").select("_leader", "_id", "_n").distinct()
    led = led.join(broadcast_if_small(materialise(lead_sizes)), "_leader").filter(_size_ok("_n", "_m", percent))
    led = led.select(F.col("_leader").alias("_a"), F.col("_id").alias("_b"))
    likely = materialise(_likely(led, reps, threshold))
    del led
    release(spark)
    first = materialise(_verify(likely, documents, ident, text, percent))
    del likely
    release(spark)
    labels = materialise(components(first))

    # large buckets that still hold several components meet other leaders, one drawn for each bucket and round
    links, rest = first, _unresolved(members, labels)
    for seed in range(leader_rounds):
        large = rest.filter(F.col("_c") > small_bucket)
        if large.isEmpty():
            break
        drawn = F.min_by("_id", F.xxhash64(F.lit(seed), "_key", "_id"))
        leaders = materialise(large.groupBy("_key").agg(drawn.alias("_lead")))
        lead = large.select("_key", F.col("_id").alias("_lead"), F.col("_label").alias("_ll"), F.col("_n").alias("_ln"))
        lead = materialise(lead.join(broadcast_if_small(leaders), ["_key", "_lead"]))
        near = large.join(broadcast_if_small(lead), "_key").filter((F.col("_label") != F.col("_ll")) & _size_ok("_n", "_ln", percent))
        pairs = near.select(F.least("_id", "_lead").alias("_a"), F.greatest("_id", "_lead").alias("_b")).distinct()
        pairs = materialise(_likely(pairs, reps, threshold))
        if pairs.isEmpty():
            continue
        links = materialise(links.union(_verify(pairs, documents, ident, text, percent)))
        labels = materialise(components(links))
        rest = _unresolved(members, labels)

    del members
    release(spark)

    # what is left is compared across components: pairs of small buckets, and for members of large ones, which as a rule
    # share a passage without being alike, pairs that share one of their rarest shingles
    apart = [rest.filter(F.col("_c") <= small_bucket)]
    large = rest.filter(F.col("_c") > small_bucket)
    if not large.isEmpty():
        prefixes = _prefixes(large.select("_id", "_n", "_label").distinct(), documents, ident, text, percent)
        rare = _mixed(prefixes.select(F.explode("_keys").alias("_key"), "_id", "_n", "_label"))
        apart.append(rare.filter(F.col("_c") <= short_list))
        large = rare.filter(F.col("_c") > short_list)
    more = materialise(_likely(_across(apart, percent), reps, threshold))
    del apart
    release(spark)
    if not more.isEmpty():
        links = materialise(links.union(_verify(more, documents, ident, text, percent)))
        release(spark)
    if not large.isEmpty():
        links = materialise(links.union(_blocks(large, prefixes, percent, block_bytes)))
        release(spark)
    labels = materialise(components(links))

    release(spark)
    representative = F.coalesce("_rep", "_id")
    named_rep = sketched.select("_id", *prints).join(broadcast_if_small(classes), prints, "left").withColumn("_rep", representative)
    found = named_rep.join(broadcast_if_small(labels.withColumnRenamed("_id", "_rep")), "_rep", "left")
    return found.select("_id", F.col("_n").alias("n_shingles"), F.coalesce("_label", "_rep").alias("component_id"))


def _repeats(ids: DataFrame) -> bool:
    return not ids.filter("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _by_rows(documents: DataFrame, ident: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written rows with a number `_row` and their id as `_name`, and (_row, n_shingles, component_id, _first) of those with an id:
    the smallest id of the component, and whether a row is the component's first by id and number."""
    numbered = materialise(documents.withColumn("_name", F.col(f"`{ident}`").cast("bigint")).withColumn("_row", F.monotonically_increasing_id()))
    rows = numbered.filter("_name IS NOT NULL").select("_row", "_name", F.col(f"`{text}`").alias("_text"))
    found = _linked(rows, materialise(sketch(rows, "_row", "_text")), "_row", "_text", percent)
    named = materialise(found.withColumnRenamed("_id", "_row").join(rows.select("_row", "_name"), "_row"))
    heads = named.groupBy("component_id").agg(F.min(F.struct("_name", "_row")).alias("_head"))
    done = named.join(heads, "component_id").select(
        "_row", "n_shingles", F.col("_head._name").alias("component_id"), (F.col("_head._row") == F.col("_row")).alias("_first")
    )
    return numbered, materialise(done)


def near_duplicates(documents: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = 75, **options) -> DataFrame:
    """_id, n_shingles, component_id and kept for every row; a row without id has no component and is kept."""
    documents = documents.select(F.col(f"`{ident}`").alias(ident), F.col(f"`{text}`").alias(text))
    sketched = materialise(sketch(documents, ident, text))
    if _repeats(sketched.select("_id")):
        numbered, found = _by_rows(documents, ident, text, percent)
        found = numbered.filter("_name IS NOT NULL").select("_row", F.col("_name").alias("_id")).join(found, "_row").select("_id", "n_shingles", "component_id")
    else:
        found = _linked(documents, sketched.filter("_id IS NOT NULL"), ident, text, percent, **options)
    nameless = sketched.filter("_id IS NULL").select("_id", F.col("_n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return found.union(nameless).withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)))


def keep_first(documents: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row of each component, that with the smallest id, and rows without an id; all columns of the input."""
    if not _repeats(documents.select(F.col(f"`{ident}`").alias("_id"))):
        dropped = near_duplicates(documents, ident, text, percent).filter(~F.col("kept")).select(F.col("_id").alias(ident))
        return documents.join(broadcast_if_small(materialise(dropped)), ident, "left_anti").select(*[f"`{c}`" for c in documents.columns])
    plain = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(documents.columns)])  # free names for the numbers
    at = {c: f"c{k}" for k, c in enumerate(documents.columns)}
    numbered, found = _by_rows(plain, at[ident], at[text], percent)
    dropped = found.filter(~F.col("_first")).select("_row")
    left = numbered.join(broadcast_if_small(dropped), "_row", "left_anti")
    return left.select(*[F.col(at[c]).alias(c) for c in documents.columns])
