"""Ranked lexical search by pipelined term partitioning.

The terms of the items are split among `owners`, the rarest terms first, so that
owners hold about equally many postings. Documents lie in shards of at most
`shard_docs`; an owner's postings of a shard are one packed row. A bundle of items
passes the owners one after the other: each stage is a cogroup of the bundle's
accumulators for a shard (document and integer score so far, only where not 0) with
that owner's postings for the shard, adds the integer contributions, and hands the
accumulators on. The last stage keeps the best of each item and shard, from
which the final selection takes the best of all.

Accumulators stay sparse without losing a result: a document is dropped once its
score and all that the later owners can add stay below the score that the shard's
k-th best document has already. No contribution reaches a million times the term's
weight, so that sum is known beforehand.

Nothing is gathered by term: a term that all documents hold is in every shard, at
most once for each document. Items are taken in blocks of about `block_terms` terms,
the one part the driver and each task hold; a block is a pass over the documents.

Edge cases: a null or empty text of an item or a document has no terms and is in no
result. A document without id counts for the statistics and is never ranked. Rows
that repeat an id are ranked each, and equal scores and ids go to the row read
first. Items that repeat an id or have none are ranked each. Texts of any length
are counted whole. Empty tables give no rows. Only ids and texts are read, so other
columns cannot clash.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import terms_of
from gleaner.llm.tokens import slices
from gleaner.session import materialise

SCALE = 1_000_000_000
MOST = 1_000_000  # no contribution per weight reaches this
DOCS, TERMS = -2, -1  # codes of the two totals among the counts
HELD = "shard bigint, bundle int, items binary, ends binary, docs binary, scores binary"
OWNED = "shard bigint, bundle int, owner int, codes binary, ends binary, docs binary, parts binary, ids binary"


@dataclass(frozen=True)
class Queries:
    """A block of items: the terms by code, and of each item its codes, how often it has them, and its place among the items."""

    code: dict[bytes, int]
    places: list[int]
    codes: list[np.ndarray]
    times: list[np.ndarray]

    def bundles(self, items: int) -> list[np.ndarray]:
        """The codes of each `items` items in a row."""
        return [np.unique(np.concatenate(self.codes[a : a + items])) for a in range(0, len(self.codes), items)]


@dataclass(frozen=True)
class Weights:
    """What the counts of all documents say of a block's terms; owner -1 has the terms of no document."""

    docs: int
    terms: int
    weight: np.ndarray
    owner: np.ndarray

    def later(self, queries: Queries, owners: int) -> np.ndarray:
        """Bound by item and owner on what the owners behind it can add."""
        out = np.zeros((len(queries.codes), owners), dtype=np.int64)
        for i, (codes, times) in enumerate(zip(queries.codes, queries.times, strict=True)):
            for k in range(owners):
                behind = self.owner[codes] > k
                out[i, k] = MOST * int((times[behind] * self.weight[codes[behind]]).sum())
        return out


def item_terms(items: DataFrame, ident: str, text: str) -> DataFrame:
    """_item (a number), _name (the id), _terms and _times of every item with a term."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(rows, "_t"):
            counted = [Counter(terms_of(t)) for t in some.column("_t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column("_item"), pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))],
                names=["_item", "_terms", "_times"],
            )

    named = materialise(items.select(F.monotonically_increasing_id().alias("_item"), F.col(f"`{ident}`").alias("_name"), F.col(f"`{text}`").alias("_t")))
    counted = named.select("_item", "_t").mapInArrow(of, "_item bigint, _terms array<binary>, _times array<bigint>")
    return materialise(counted.filter(F.size("_terms") > 0).join(named.select("_item", "_name"), "_item"))


def block_of(rows: list) -> Queries:
    code: dict[bytes, int] = {}
    codes, times = [], []
    for r in rows:
        codes.append(np.array([code.setdefault(bytes(t), len(code)) for t in r["_terms"]], dtype=np.int64))
        times.append(np.array(r["_times"], dtype=np.int64))
    return Queries(code, [r["_item"] for r in rows], codes, times)


def postings(documents: DataFrame, code: dict[bytes, int], ident: str, text: str, shard_docs: int) -> DataFrame:
    """Packed runs of documents in shards: ids, how many terms each has, and the wanted ones as (document, code, times)."""
    shared, wanted = documents.sparkSession.sparkContext.broadcast(code), max(1, len(code))
    schema = "shard bigint, first int, ids binary, known binary, n binary, docs binary, codes binary, times binary"

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, get = TaskContext.get().partitionId() << 24, 0, shared.value.get
        for some in slices(rows, "_t", at_most=min(500, shard_docs)):
            if held + len(some) > shard_docs:
                shard, held = shard + 1, 0
            words = [terms_of(t) for t in some.column("_t").cast(pa.binary()).to_pylist()]
            n = np.array([len(w) for w in words], dtype="<i8")
            found = np.fromiter(map(get, itertools.chain(*words), itertools.repeat(-1)), dtype=np.int64, count=int(n.sum()))
            pair, times = np.unique((np.repeat(np.arange(len(n)), n) * wanted + found)[found >= 0], return_counts=True)
            ids = some.column("_id")
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "first": pa.array([held], pa.int32()),
                "ids": [ids.fill_null(0).to_numpy().astype("<i8").tobytes()], "known": [ids.is_valid().to_numpy(zero_copy_only=False).tobytes()],
                "n": [n.tobytes()], "docs": [(pair // wanted).astype("<u2").tobytes()],
                "codes": [(pair % wanted).astype("<u4").tobytes()], "times": [times.astype("<u4").tobytes()],
            })
            held += len(some)

    source = documents.select(F.col(f"`{ident}`").cast("bigint").alias("_id"), F.col(f"`{text}`").alias("_t"))
    return source.mapInArrow(of, schema)


def statistics(packed: DataFrame, n_codes: int, owners: int) -> Weights:
    """Counts in one vector a task, then partial sums; a number for each term of the block reaches the driver."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs, terms = np.zeros(n_codes, dtype=np.int64), 0, 0
        for frame in frames:
            for codes, n in zip(frame["codes"], frame["n"], strict=True):
                df += np.bincount(np.frombuffer(codes, dtype="<u4"), minlength=n_codes)
                lengths = np.frombuffer(n, dtype="<i8")
                docs, terms = docs + int((lengths > 0).sum()), terms + int(lengths.sum())
        at = np.flatnonzero(df)
        yield pd.DataFrame({"code": np.append(at, [DOCS, TERMS]), "n": np.append(df[at], [docs, terms])})

    sums = packed.select("codes", "n").mapInPandas(of, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    count = dict(zip(sums.column("code").to_pylist(), sums.column("n").to_pylist(), strict=True))
    docs, terms = count.pop(DOCS, 0), count.pop(TERMS, 0)
    df = np.zeros(n_codes, dtype=np.int64)
    df[list(count)] = list(count.values())
    weight = np.array([math.floor(1000 * math.log((2.0 * docs + 2) / (2.0 * d + 1))) for d in df.tolist()], dtype=np.int64)
    order = np.lexsort((np.arange(n_codes), -weight))
    owner = np.full(n_codes, -1)
    done = df[order].cumsum()
    owner[order] = np.minimum(owners - 1, (done - df[order]) * owners // max(1, int(df.sum())))
    owner[df == 0] = -1
    return Weights(docs, terms, weight, owner)


def dealt(packed: DataFrame, weights: Weights, bundles: list[np.ndarray], owners: int) -> DataFrame:
    """One row for each shard, bundle and owner: postings by code, with what a unit of weight adds for each. The last owner's row
    has the ids and is never left out."""
    shared = packed.sparkSession.sparkContext.broadcast((weights, bundles))

    def rows(parts: list) -> Iterator[tuple]:
        w, wanted = shared.value
        n = np.concatenate([np.frombuffer(p.n, dtype="<i8") for p in parts])
        known = np.concatenate([np.frombuffer(p.known, dtype=bool) for p in parts])
        docs = np.concatenate([np.frombuffer(p.docs, dtype="<u2").astype(np.int64) + p.first for p in parts])
        codes = np.concatenate([np.frombuffer(p.codes, dtype="<u4") for p in parts]).astype(np.int64)
        times = np.concatenate([np.frombuffer(p.times, dtype="<u4") for p in parts]).astype(np.int64)
        m = 75 + (25 * n * w.docs) // max(1, w.terms)
        adds = SCALE * times // (1000 * times + 12 * m[docs])
        keep = known[docs] & (adds > 0)
        order = np.argsort(codes[keep], kind="stable")
        docs, codes, adds = docs[keep][order], codes[keep][order], adds[keep][order]
        owner = w.owner[codes]
        for bundle, own in enumerate(wanted):
            inside = np.zeros(len(w.weight), dtype=bool)
            inside[own] = True
            for k in range(owners):
                at = np.flatnonzero((owner == k) & inside[codes])
                if len(at) or k == owners - 1:
                    first = np.flatnonzero(np.diff(codes[at], prepend=-1))
                    yield (
                        parts[0].shard, bundle, k, codes[at][first].astype("<u4").tobytes(), np.append(first, len(at))[1:].astype("<u4").tobytes(),
                        docs[at].astype("<u2").tobytes(), adds[at].astype("<u4").tobytes(), b"".join(p.ids for p in parts) if k == owners - 1 else None,
                    )

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OWNED.split(", ")]
        waiting: list = []
        for frame in frames:
            for part in frame.itertuples(index=False):
                if waiting and waiting[0].shard != part.shard:
                    yield pd.DataFrame(list(rows(waiting)), columns=columns)
                    waiting = []
                waiting.append(part)
        if waiting:
            yield pd.DataFrame(list(rows(waiting)), columns=columns)

    return packed.mapInPandas(of, OWNED)


def _best(scores: np.ndarray, k: int) -> int:
    """The k-th highest score, 0 with fewer."""
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0


def _stage(k: int, last: bool, queries, keep: int, bundle_items: int):
    """The work of owner `k` on one bundle and shard."""

    def of(key: tuple, held: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
        block, weights, later = queries.value
        first = int(key[1]) * bundle_items
        here = range(first, min(first + bundle_items, len(block.codes)))
        so_far: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(held):
            docs, scores = np.frombuffer(held["docs"].iat[0], dtype="<u2"), np.frombuffer(held["scores"].iat[0], dtype="<i8")
            start = 0
            for i, end in zip(np.frombuffer(held["items"].iat[0], dtype="<u4"), np.frombuffer(held["ends"].iat[0], dtype="<u4"), strict=True):
                so_far[int(i)] = docs[start:end], scores[start:end]
                start = end
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ids = None
        if len(owned):
            docs, adds = np.frombuffer(owned["docs"].iat[0], dtype="<u2"), np.frombuffer(owned["parts"].iat[0], dtype="<u4").astype(np.int64)
            start = 0
            for c, end in zip(np.frombuffer(owned["codes"].iat[0], dtype="<u4"), np.frombuffer(owned["ends"].iat[0], dtype="<u4"), strict=True):
                lists[int(c)] = docs[start:end], adds[start:end]
                start = end
            ids = np.frombuffer(owned["ids"].iat[0], dtype="<i8") if last else None
        score = np.zeros(1 << 16, dtype=np.int64)
        out, best = [], []
        for i in here:
            if i in so_far:
                score[so_far[i][0]] = so_far[i][1]
            mine = weights.owner[block.codes[i]] == k
            for c, times in zip(block.codes[i][mine].tolist(), block.times[i][mine].tolist(), strict=True):
                if c in lists:
                    score[lists[c][0]] += times * int(weights.weight[c]) * lists[c][1]
            docs = np.flatnonzero(score)
            values = score[docs]
            score[docs] = 0
            kept = values + later[i, k] >= _best(values, keep)
            docs, values = docs[kept], values[kept]
            if last:
                order = np.lexsort((docs, ids[docs], -values))[:keep]
                best += [(block.places[i], int(d), int(v), (int(key[0]) << 16) + at) for d, v, at in zip(ids[docs[order]], values[order], docs[order].tolist(), strict=True)]
            elif len(docs):
                out.append((i, docs.astype("<u2"), values.astype("<i8")))
        if last:
            return pd.DataFrame(best, columns=["_item", "doc_id", "score", "_row"])
        packed = [
            np.array([i for i, _, _ in out], dtype="<u4"), np.cumsum([len(d) for _, d, _ in out]).astype("<u4"),
            np.concatenate([d for _, d, _ in out]) if out else np.empty(0, "<u2"), np.concatenate([v for _, _, v in out]) if out else np.empty(0, "<i8"),
        ]
        rows = [(int(key[0]), int(key[1]), *[x.tobytes() for x in packed])] if out else []
        return pd.DataFrame(rows, columns=["shard", "bundle", "items", "ends", "docs", "scores"])

    return of


def _block(
    queries: Queries, documents: DataFrame, ident: str, text: str, k: int, owners: int, shard_docs: int, bundle_items: int
) -> DataFrame:
    """_item, doc_id, score and _row of the best of each shard, for one block of items."""
    spark = documents.sparkSession
    packed = materialise(postings(documents, queries.code, ident, text, shard_docs))
    weights = statistics(packed, len(queries.code), owners)
    owned = materialise(dealt(packed, weights, queries.bundles(bundle_items), owners))
    codes_only = Queries({}, queries.places, queries.codes, queries.times)
    shared = spark.sparkContext.broadcast((codes_only, weights, weights.later(queries, owners)))
    held = spark.createDataFrame([], HELD)
    for stage in range(owners):
        last = stage == owners - 1
        work = _stage(stage, last, shared, k, bundle_items)
        mine = owned.filter(F.col("owner") == stage)
        both = held.groupBy("shard", "bundle").cogroup(mine.groupBy("shard", "bundle"))
        held = both.applyInPandas(work, "_item bigint, doc_id bigint, score bigint, _row bigint" if last else HELD)
    return held


def search(
    items: DataFrame, documents: DataFrame, item: str = "item_id", ident: str = "doc_id", text: str = "text", k: int = 20,
    owners: int = 4, shard_docs: int = 16_384, bundle_items: int = 256, block_terms: int = 500_000,
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `k` best documents."""
    if not 0 < shard_docs <= 1 << 16:
        raise ValueError("a shard has at most 65,536 documents")
    named = item_terms(items, item, text)
    total = named.agg(F.sum(F.size("_terms"))).first()[0] or 0
    blocks, found = -(-total // block_terms), None
    for b in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).select("_item", "_terms", "_times").collect()
        if rows:
            part = _block(block_of(rows), documents, ident, text, k, owners, shard_docs, bundle_items)
            found = part if found is None else found.union(part)
    names = named.select("_item", F.col("_name").alias("item_id"))
    if found is None:
        found = documents.sparkSession.createDataFrame([], "_item bigint, doc_id bigint, score bigint, _row bigint")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), "doc_id", "_row")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(names, "_item").select("item_id", "rank", "doc_id", "score")
