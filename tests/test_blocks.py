"""Operators that work block by block, against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import greedy, lowrank, signals
from gleaner.sources import encode, runlog
from gleaner.session import scratch_path


def frame(spark, x, labels, parts=4):
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(parts)


# --- classes -----------------------------------------------------------------------------


def softmax(x, labels):
    names = sorted(set(labels))
    centres = np.array([x[labels == c].mean(axis=0) for c in names])
    logits = -((x[:, None] - centres[None]) ** 2).sum(axis=2)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return np.searchsorted(names, labels), e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("rows,classes,limit", [(2048, 1024, 64 << 20), (7, 3, 64 << 20), (50, 1, -1), (9, 4, -1)])
def test_streaming_softmax_is_the_softmax(spark, monkeypatch, rows, classes, limit):
    monkeypatch.setattr("gleaner.scale.blocks.BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    labels = rng.integers(5, 25, 300)
    x = rng.normal(size=(300, 6)) + labels[:, None] * 0.3
    y, p = softmax(x, labels)
    found = {r["id"]: r for r in signals.class_softmax(frame(spark, x, labels), rows=rows, classes=classes).collect()}
    assert len(found) == 300
    for k, r in found.items():
        assert r["y"] == y[k]
        assert [r["loss"], r["top"], r["first"], r["total"]] == pytest.approx([-math.log(p[k, y[k]]), p[k].max(), p[k, 0], 1.0], rel=1e-9)


def test_a_hundred_thousand_classes(spark):
    """No row and no task holds all classes: 100 blocks of 1024 pass by, and each row is told by its own centroid."""
    n = 100_000
    base = spark.range(0, n, 1, 8).select("id", F.col("id").cast("int").alias("label"), F.array(
        (F.col("id") % 100).cast("double"), F.floor(F.col("id") / 100 % 100).cast("double"), F.floor(F.col("id") / 10_000).cast("double"),
    ).alias("x"))
    centres = base.select("label", F.col("x").alias("centroid"), F.col("id").alias("place"))
    found = signals.class_softmax(base.filter("id % 97 = 0"), centroids=centres).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == F.col("id")).alias("own"), F.min("top").alias("low"), F.max("total").alias("high"),
    ).first()
    assert found["n"] == found["own"] == 1031
    # a grid point inside has the weight 1 / (1 + 2/e + ...)^3 of its neighbours on each axis
    assert found["low"] == pytest.approx(1 / sum(math.exp(-(k**2)) for k in range(-9, 10)) ** 3, rel=1e-6)
    assert found["high"] == pytest.approx(1.0)


def test_rows_without_vector_or_label_and_no_rows(spark):
    rows = [(1, [0.0, 1.0], 1), (2, None, 1), (3, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    assert [r["id"] for r in signals.class_softmax(df).collect()] == [1]
    assert signals.class_softmax(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows,classes,limit", [(2048, 1024, 64 << 20), (9, 2, -1)])
def test_alignment_by_blocks(spark, monkeypatch, rows, classes, limit):
    monkeypatch.setattr("gleaner.scale.blocks.BROADCAST_BYTES", limit)
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 7, 200)
    x = rng.normal(size=(200, 5))
    y, p = softmax(x, labels)
    error = p.copy()
    error[np.arange(200), y] -= 1
    g, b = error.T @ x / 200, error.mean(axis=0)
    each = [np.outer(e, v) for e, v in zip(error, x, strict=True)]
    cos = lambda u, v: float((u * v).sum() / (max(np.linalg.norm(u), 1e-8) * max(np.linalg.norm(v), 1e-8)))
    expected = [((cos(each[k], g) + cos(error[k], b)) / 2 + 1) / 2 for k in range(200)]
    staged = signals.centroid_signals(frame(spark, x, labels)).select("id", "x", "p", "y")
    found = dict(signals.grad_alignment(staged, rows=rows, classes=classes).collect())
    assert [found[k] for k in range(200)] == pytest.approx(expected, rel=1e-9)
    mean = {r["place"]: r for r in signals.mean_gradient(staged, classes=classes, held=12).collect()}
    assert np.allclose([mean[c]["g"] for c in range(7)], g) and np.allclose([mean[c]["b"] for c in range(7)], b)


# --- low rank ----------------------------------------------------------------------------


def lost(x, directions):
    return float(((x - x @ directions @ directions.T) ** 2).sum())


@pytest.mark.parametrize("parts,size", [(1, 16), (7, 16), (40, 24), (3, 12)])
def test_sketches_keep_the_published_bound(spark, parts, size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 40)) * (0.8 ** np.arange(40)) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    df = frame(spark, x, np.zeros(1500), parts)
    best = float((np.linalg.svd(x, compute_uv=False)[8:] ** 2).sum())
    directions = lowrank.principal_directions(df, "x", 8, size=size)
    assert np.allclose(directions.T @ directions, np.eye(8))
    assert best * (1 - 1e-9) <= lost(x, directions) <= (1 + 8 / (size - 8)) * best
    assert lost(x, lowrank.principal_directions(df, "x", 8, size=40)) == pytest.approx(best)  # as many rows as dimensions lose nothing


def test_sketches_by_key_merge_in_rounds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 10))
    df = frame(spark, x, np.arange(900) % 3, 30)
    found = {r["label"]: r["_sketch"] for r in lowrank.sketches(df, ["label"], "x", 10, fan_in=4).collect()}
    assert sorted(found) == [0, 1, 2]
    for c in range(3):
        sketch = np.frombuffer(found[c]).reshape(-1, 10)
        assert np.allclose(sketch.T @ sketch, x[c::3].T @ x[c::3])


def test_projection_of_nulls_and_short_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(20)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    done = {r["id"]: r for r in lowrank.project(df, "x", 2).collect()}
    assert done[99]["projected"] is None and done[99]["residual"] is None and len(done[0]["projected"]) == 2
    assert lowrank.project(df, "x", 4).filter("residual > 0").isEmpty()


def test_two_sided_projection(spark):
    """Against the singular value decomposition of each turn's first matrix."""
    rng = np.random.default_rng(6)
    mats = {s: rng.normal(size=(12, 9)) @ np.diag(0.5 ** np.arange(9)) for s in range(5)}
    rows = [("a", s, r, m[r].tolist()) for s, m in mats.items() for r in range(12)]
    df = spark.createDataFrame(rows, "name string, step long, row long, x array<double>").repartition(5)
    core, back = lowrank.project_matrices(df, "name", "step", "row", "x", 3, 2, size=9)
    restored = {(r["step"], r["row"]): np.array(r["restored"]) for r in back.collect()}
    cores = {r["step"]: np.array(r["core"]).reshape(3, 3) for r in core.collect()}
    for s, m in mats.items():
        u, _, vt = np.linalg.svd(mats[s // 2 * 2])
        expected = u[:, :3] @ u[:, :3].T @ m @ vt[:3].T @ vt[:3]
        assert np.allclose([restored[s, r] for r in range(12)], expected, atol=1e-8)
        assert (cores[s] ** 2).sum() == pytest.approx((expected**2).sum())
    assert {r["step"] for r in back.filter("residual IS NULL").collect()} == set()


# --- greedy ------------------------------------------------------------------------------


def test_coreset_gains_like_the_exact_greedy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 8)) + rng.integers(0, 6, 3000)[:, None] * 2
    df = frame(spark, x, np.zeros(3000)).withColumn("static", F.pmod(F.col("id"), F.lit(17)) / 17.0)
    exact = greedy.greedy_select(df, 120, static="static", weight=0.5)
    for options in ({}, {"part_rows": 300, "block": 64}):
        found = greedy.greedy_coreset(df, 120, static="static", weight=0.5, **options)
        rows = found.collect()
        assert sorted(r["rank"] for r in rows) == list(range(1, 121)) and len({r["id"] for r in rows}) == 120
        assert sum(r["gain"] for r in rows) >= 0.95 * exact.agg(F.sum("gain")).first()[0]
        # the gains are those of this order of picks, not of another set
        order, near = sorted(rows, key=lambda r: r["rank"]), np.ones(3000)
        for n, r in enumerate(order):
            assert r["gain"] == pytest.approx((r["id"] % 17) / 17.0 + 0.5 * near[r["id"]])
            apart = np.sqrt(((x - x[r["id"]]) ** 2).sum(axis=1))
            near = np.minimum(near, apart) if n else apart


def test_coreset_of_more_than_there_is_and_of_copies(spark):
    df = frame(spark, np.zeros((40, 3)), np.zeros(40))
    rows = greedy.greedy_coreset(df, 60, part_rows=10).collect()
    assert len({r["id"] for r in rows}) == 40
    assert greedy.greedy_coreset(df.limit(0), 5).count() == 0


# --- encoding and logs -------------------------------------------------------------------


def test_codes_of_words(spark):
    rows = [(1, "b a a c"), (2, ""), (3, None), (4, "zz a"), (5, " ".join("abcabc") * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "word string, token int")
    for held in (100, 1):
        found = {r["doc_id"]: r for r in encode.encode_fixed(df, vocab, max_length=6, held_words=held).collect()}
        assert found[1]["input_ids"] == [3, 2, 2, 4, 0, 0] and found[1]["attention_mask"] == [1, 1, 1, 1, 0, 0]
        assert found[2]["input_ids"] == found[3]["input_ids"] == [0] * 6 and found[4]["input_ids"] == [1, 2, 0, 0, 0, 0]
        assert len(found[5]["input_ids"]) == 6 and found[5]["labels"] == found[5]["input_ids"]


def test_codes_need_no_shuffle(spark, capsys):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    vocab = spark.createDataFrame([("a", 2)], "word string, token int")
    encode.encode_fixed(df, vocab).explain("simple")
    assert "Exchange" not in capsys.readouterr().out


LOG = "run string, kind string, epoch long, ts string, payload double"


def test_a_batch_that_comes_again_counts_once(spark):
    path = scratch_path(spark, "log")
    one = spark.createDataFrame([("r", "epoch", k, "t", float(k)) for k in range(9)] + [("r", "epoch", 0, "t", 0.0)], LOG)
    two = spark.createDataFrame([("s", "timing", 1, "t", None)], LOG)
    for _ in range(2):
        runlog.append_log(one, path)  # its content names it, whatever the partitions and their order
        runlog.append_log(two, path, 7)
        one = one.repartition(3)
    log = runlog.read_log(spark, path)
    assert log.count() == 11 and set(log.columns) == {"run", "kind", "epoch", "ts", "payload"}
    runlog.append_log(spark.createDataFrame([("s", "timing", 2, "t", 2.0), ("u", "epoch", 3, "t", 3.0)], LOG), path, 7)  # replaced
    assert {(r["run"], r["epoch"]) for r in runlog.read_log(spark, path).filter("run <> 'r'").collect()} == {("s", 2), ("u", 3)}


def test_a_batch_that_failed_is_not_seen(spark):
    path = scratch_path(spark, "log")
    good = spark.createDataFrame([("r", "epoch", 1, "t", 1.0)], LOG)
    runlog.append_log(good, path, "a")
    with pytest.raises(Exception):
        runlog.append_log(good.withColumn("payload", F.raise_error(F.lit("lost")).cast("double")), path, "b")
    assert runlog.read_log(spark, path).count() == 1


def test_documents_are_chunks_in_order(spark):
    log = spark.createDataFrame([("r", "epoch", k * 7 % 101, "t", float(k)) for k in range(101)] + [("s", "timing", 0, "t", 1.0)], LOG).repartition(5)
    chunks = runlog.run_chunks(log, 10).filter("run = 'r'").orderBy("chunk").collect()
    assert [len(c["records"]) for c in chunks] == [10] * 10 + [1]
    assert [r["epoch"] for c in chunks for r in c["records"]] == list(range(101))
    assert runlog.run_summary(log, 10).count() == 12
    flat = spark.range(25).select(
        F.lit("r").alias("run"), (24 - F.col("id")).alias("epoch"), (24.0 - F.col("id")).alias("train_loss"), F.lit(0.0).alias("val_loss"),
        F.lit(0.0).alias("val_accuracy"), F.lit("x").alias("strategy"),
    )
    folded = runlog.fold_results(flat, 10)
    assert folded.count() == 3
    assert sorted((r["epoch"], r["train_loss"]) for r in runlog.explode_results(folded).collect()) == [(k, float(k)) for k in range(25)]
