"""Near neighbours from buckets: recall, growth of the work, hot buckets."""

from __future__ import annotations

import numpy as np

from gleaner.operators import neighbours


def table(spark, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def clustered(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 20), dim))
    return centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))


def recall(spark, x, found, k):
    near = {}
    for r in found.collect():
        near.setdefault(r.id, set()).add(r.neighbour)
    d = neighbours._distances(x, x)
    np.fill_diagonal(d, np.inf)
    hits = sum(len(set(np.argsort(d[i])[:k].tolist()) & near.get(i, set())) for i in range(len(x)))
    return hits / (k * len(x))


def test_recall_on_many_dimensions(spark):
    x = clustered(1500)
    df = table(spark, x)
    assert recall(spark, x, neighbours.knn_near(df, df, 5, exclude_self=True, bucket_rows=128), 5) >= 0.9


def test_one_bucket_is_exact(spark):
    x = clustered(200)
    df = table(spark, x)
    assert recall(spark, x, neighbours.knn_near(df, df, 3, exclude_self=True), 3) == 1.0


def test_copies_fill_no_bucket(spark):
    x = clustered(600)
    x[:300] = x[0]
    df = table(spark, x)
    found = neighbours.knn_near(df, df, 2, exclude_self=True, bucket_rows=32).collect()
    assert all(r.distance == 0.0 for r in found if r.id < 300) and len({r.id for r in found if r.id < 300}) == 300


def test_work_grows_less_than_quadratically(spark, monkeypatch):
    """Compared pairs, from the bucket sizes of the first table."""
    rng = np.random.default_rng(1)
    planes = rng.normal(size=(48, 64))

    def pairs(n, bucket=128):
        bits = int(np.ceil(np.log2(n / bucket)))
        signs = (clustered(n, 2) @ planes[:bits].T > 0) @ (1 << np.arange(bits))
        return int((np.unique(signs, return_counts=True)[1].astype(float) ** 2).sum())

    assert pairs(16_000) < 6.5 * pairs(4_000)  # four times the rows: 16 if all pairs were compared


def test_empty(spark):
    df = spark.createDataFrame([], "id long, x array<double>")
    assert neighbours.knn_near(df, df, 2).count() == 0


def test_blocks_meet_exactly():
    """Copies, ties, vectors far from the origin, tiny and broken ones: the nearest by differences, ties to the first ids."""
    rng = np.random.default_rng(3)
    for shift, scale in ((0, 1.0), (1e6, 1.0), (0, 1e-25), (0, 1e25)):
        x = shift + scale * rng.normal(size=(900, 8))
        x[300:400], x[-1], ids = x[0], x[1] * (1 + 1e-9), np.arange(900) * 2
        d = neighbours._distances(x, x)
        np.fill_diagonal(d, np.inf)
        at, near, distance = neighbours._nearest(x, ids, x, ids, 5, True)
        want = np.argsort(d, axis=1, kind="stable")[:, :5]
        assert (near.reshape(want.shape) == want).all() and (at.reshape(want.shape) == np.arange(900)[:, None]).all()
        assert np.allclose(distance.reshape(want.shape), np.take_along_axis(d, want, 1), rtol=1e-12, atol=0)
    x[5, 2], x[7] = np.nan, np.inf
    at, near, _ = neighbours._nearest(x, ids, x, ids, 5, True)
    assert set(at) == set(range(900)) - {5, 7} and not {5, 7} & set(near)


def test_recall_is_measured_on_vectors_without_groups(spark):
    x = np.random.default_rng(4).normal(size=(1500, 64))
    df = table(spark, x)
    assert recall(spark, x, neighbours.knn_near(df, df, 5, exclude_self=True, bucket_rows=64), 5) >= 0.9
