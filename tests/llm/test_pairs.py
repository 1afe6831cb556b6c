from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import norm_search as ns
from gleaner.llm import setsketch as sk
from gleaner.llm.queries import QUERIES
from tests.llm.cases import documents, empty, words


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_hand(texts):
    """Union-find over every pair: the definition."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(rows, texts):
    expected = components_by_hand(texts)
    got = {r["_id"] if "_id" in r else r["doc_id"]: (r.n_shingles, r.component_id) for r in (x.asDict() | {} for x in rows) for r in [type("R", (dict,), {"__getattr__": dict.get})(r)]}
    assert got == expected
    assert len(rows) == len(texts)


def test_near_duplicate_query(spark, folder):
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op10_setsketch"](spark, folder).collect()
    check(rows, texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def variants(seed):
    """Copies that drift away from a core, texts that share a passage, and exact copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    core, passage = [word() for _ in range(90)], [word() for _ in range(60)]
    out = []
    for k in range(60):
        edited = list(core)
        for _ in range(k % 12):
            edited[rng.randrange(len(edited))] = word()
        out.append(" ".join(edited))
    out += [" ".join(passage + [word() for _ in range(rng.randrange(10, 40))]) for _ in range(60)]
    out += [" ".join(core)] * 15 + ["a b c", "A  b\tc", "a b c d", "", None]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"small_bucket": 3, "short_list": 3, "block_bytes": 20_000}, {"small_bucket": 2, "short_list": 2, "block_bytes": 10**9, "leader_rounds": 1}])
def test_all_ways_give_the_exact_components(spark, options):
    texts = dict(enumerate(variants(3), 1))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(sk.near_duplicates(frame, **options).collect(), texts)


@pytest.mark.parametrize("cells", [1 << 15, 1 << 22])
def test_bands_without_a_bucket_stay_where_they_are(spark, cells):
    """No row of a bucket is lost, however small the bitmap; with a large one hardly any other row goes along."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(40)) for _ in range(200)] + [t for t in variants(4) if t]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = sk.materialise(sk.sketch(frame))
    rows = sk._bands(reps)
    buckets = sk.materialise(rows.groupBy("_key").agg(F.count("*").alias("_size")).filter("_size > 1"))
    wanted = {tuple(r) for r in rows.join(buckets, "_key").select("_key", "_id", "_n").collect()}
    some = [tuple(r) for r in sk._bands(reps, sk._cells(buckets, cells)).collect()]
    assert wanted and wanted <= set(some) and len(some) == len(set(some)) <= rows.count()
    assert cells < 1 << 22 or len(some) < len(wanted) + 0.05 * (rows.count() - len(wanted))


def test_near_duplicate_edge_rows(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    rows = sk.near_duplicates(docs).collect()
    assert len(rows) == 16  # a row per document, the one without id too
    check([r for r in rows if r["_id"] is not None], texts)
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r["_id"] is None] == [(len(shingle_set("a row without an id but with a text of its own")), None, True)]
    kept = sk.keep_first(docs)
    assert kept.columns == docs.columns
    first = {i for i, (_, c) in components_by_hand(texts).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == first | {None}
    assert sk.near_duplicates(empty(spark)).count() == 0 and sk.keep_first(empty(spark)).count() == 0


def test_repeated_ids(spark):
    """Rows are linked one by one where ids repeat: with their copies, and where texts under one id differ."""
    docs = documents(spark)
    expected = components_by_hand({r.doc_id: r.text for r in docs.collect() if r.doc_id is not None})
    again = sk.near_duplicates(docs.union(docs)).collect()
    assert len(again) == 32 and {(r["_id"], r.component_id) for r in again if r["_id"]} == {(i, c) for i, (_, c) in expected.items()}
    kept = sk.keep_first(docs.union(docs))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    empty_sets = [i for i, (n, _) in expected.items() if not n]  # linked with nothing, their own copies neither
    assert sorted(ids) == sorted([i for i, (_, c) in expected.items() if i == c] + empty_sets)
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(7, long), (7, "quite another text of seven words"), (3, long + " and more"), (9, "quite another text of seven words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["_id"], r.component_id, r.n_shingles) for r in sk.near_duplicates(frame).collect())
    assert found == [(3, 3, 58), (7, 3, 56), (7, 7, 2), (9, 7, 2)]
    assert sorted(map(tuple, sk.keep_first(frame).collect())) == [(3, long + " and more"), (7, "quite another text of seven words")]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(s) for s in (pool[:1000], pool[100:1100], pool[3000:], pool[:2])]
    regs = sk.registers(sets)
    assert (sk.merge(regs[0], regs[1]) == sk.registers([np.union1d(sets[0], sets[1])])[0]).all()
    sizes = np.array([len(s) for s in sets], dtype=float)
    guess = sk.estimate(regs[[0, 0, 0]], regs[[1, 2, 3]], sizes[[0, 0, 0]], sizes[[1, 2, 3]])
    assert abs(guess[0] - 900 / 1100) < 0.07 and guess[1] < 0.03 and guess[2] < 0.01


def test_bands_recall_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    found = 0
    for _ in range(40):
        shared = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, 50).astype(np.uint64)])) for _ in range(2))
        keys = sk.band_keys(sk.registers([a, b]))
        found += bool((keys[0] == keys[1]).any())
    assert found == 40


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300)], "_a long, _b long")
    got = dict(sk.components(links).collect())
    assert got == {k: 1 for k in range(2, 61)} | {200: 100, 300: 100}


def top_by_hand(rows, is_query, k):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in usable if c != q)[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread,block_bytes", [(0.0, 2_000_000), (1.0, 4096), (3.0, 4096)])
def test_search_equals_brute_force(spark, spread, block_bytes):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 8)) * np.exp(spread * rng.normal(size=(700, 1)))
    vectors[10:20] = vectors[10]  # ties
    vectors[20] = 0
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [float("nan")] * 8), (None, [1.0] * 8), (1100, [None] + [1.0] * 7), (1150, [float("inf")] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_v", F.lit("clash"))
    got = ns.top_inner(frame, F.col("vec_id") % 25 == 0, block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in got) == top_by_hand(rows, lambda q: q % 25 == 0, 5)


def test_search_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ns.top_inner(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert ns.top_inner(spark.createDataFrame([(1, None)], schema), F.col("vec_id") % 50 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.9])], schema)
    got = ns.top_inner(three, F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 32768), (2, 2, 32768)]


def test_bounds_prune_most_pairs():
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(5000, 64)) * np.exp(rng.normal(size=(5000, 1))) * np.linspace(2, 0.1, 64)).astype(np.int64)
    order = np.argsort(-np.linalg.norm(v, axis=1))
    counts: dict[str, int] = {}
    queries = (np.arange(100), v[:100], np.full(100, -np.inf))
    ns.search_block(queries, (order, v[order]), ns.rotation((v.T @ v).astype(float)), 5, (16, 32, 64), counts)
    assert counts["scored"] < 0.05 * counts["pairs"]
