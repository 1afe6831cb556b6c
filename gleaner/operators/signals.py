"""Providers of class probabilities, and the gradients of the mean sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import signals as S
from gleaner.functions import vectors as V
from gleaner.scale import against, group_rank, matrix, parts_of
from gleaner.session import materialise


def class_centroids(df: DataFrame, vector: str = "x", label: str = "label") -> DataFrame:
    """(label, centroid): mean vector per class, combined on the map side."""
    return df.groupBy(label).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid")
    )


def with_centroids(df: DataFrame, vector: str = "x", label: str = "label") -> DataFrame:
    """Adds `classes` and `centroids`, arrays in label order.

    They come as one value of a scalar subquery: classes times dimensions
    numbers, which do not grow with the rows.
    """
    ordered = class_centroids(df, vector, label).agg(
        F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("c")
    )
    packed = df.withColumn("_c", ordered.select("c").scalar())
    return packed.withColumn("classes", F.col("_c.label")).withColumn("centroids", F.col("_c.centroid")).drop("_c")


def centroid_signals(df: DataFrame, vector: str = "x", label: str = "label") -> DataFrame:
    """Adds y, p (softmax of the negative squared distances to the centroids) and loss."""
    logits = F.transform("centroids", lambda c: -V.squared_distance(F.col(vector), c))
    return _finish(with_centroids(df, vector, label).withColumn("p", S.softmax(logits)), label)


def _finish(df: DataFrame, label: str) -> DataFrame:
    y = (F.array_position("classes", F.col(label)) - 1).cast("int")
    return df.withColumn("y", y).withColumn("loss", S.cross_entropy(F.col("p"), F.col("y")))


def logistic_signals(df: DataFrame, vector: str = "x", label: str = "label", iterations: int = 20) -> DataFrame:
    """As `centroid_signals`, with a trained multinomial logistic regression.

    Labels must be 0 .. k-1.
    """
    features = df.withColumn("_f", array_to_vector(F.col(vector)))
    model = LogisticRegression(
        featuresCol="_f", labelCol=label, probabilityCol="_p", predictionCol="_q", rawPredictionCol="_z",
        maxIter=iterations, regParam=0.01, family="multinomial",
    ).fit(features.withColumn(label, F.col(label).cast("double")))
    scored = model.transform(features).withColumn("p", vector_to_array("_p")).drop("_f", "_p", "_q", "_z")
    return scored.withColumn("y", F.col(label).cast("int")).withColumn("loss", S.cross_entropy(F.col("p"), F.col("y")))


def _numbered(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(place, label, centroid): the classes numbered from 0 in label order."""
    found = class_centroids(df, vector, label)
    kind = dict(found.dtypes)[label]
    if kind in ("string", "date", "boolean"):
        place = F.row_number().over(Window.orderBy(label))
        return found.withColumn("place", (place - 1).cast("bigint"))
    ranked = group_rank(materialise(found), [], label, label)
    return ranked.select((F.col("_rank") - 1).cast("bigint").alias("place"), label, "centroid")


def class_softmax(
    df: DataFrame, vector: str = "x", label: str = "label", ident: str = "id", rows: int = 2048, classes: int = 1024, centroids: DataFrame | None = None,
) -> DataFrame:
    """ident, y, loss, top, first, total of the softmax over the negative squared distances to any number of class centroids.

    Streaming softmax: a block of rows meets a block of classes at a time and keeps, for
    each row, the largest logit so far and the sum of the others relative to it; such
    states merge exactly. Neither all centroids nor all probabilities of a row are
    ever in one place. `top` is the highest probability, `first` that of the lowest
    label, `total` their sum. Rows with a null vector or label are left out. `centroids`
    (label, centroid, place from 0) stand in for those of the rows' own classes.
    """
    df = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    kinds = dict(df.dtypes)
    schema = f"block bigint, {ident} {kinds[ident]}, y bigint, most double, sum double, own double, first double"
    named = _numbered(df, vector, label) if centroids is None else centroids

    def of(pairs: Iterator) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for block, some, _, members in pairs:
            if block != last:
                if state is not None:
                    yield pd.DataFrame(state)
                last, x = block, matrix(some.column(vector))
                labels, square, n = some.column(label).to_pandas(), (x * x).sum(axis=1), len(x)
                state = {
                    "block": np.full(n, block), ident: some.column(ident).to_numpy(), "y": np.full(n, -1), "most": np.full(n, -np.inf),
                    "sum": np.zeros(n), "own": np.full(n, -np.inf), "first": np.full(n, -np.inf),
                }
            c, place = matrix(members.column("centroid")), members.column("place").to_numpy()
            logits = -np.maximum(square[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1), 0.0)
            _add(state, logits.max(axis=1), np.exp(logits - logits.max(axis=1)[:, None]).sum(axis=1))
            at = pd.Index(members.column(label).to_pandas()).get_indexer(labels)
            here = np.flatnonzero(at >= 0)
            state["own"][here], state["y"][here] = logits[here, at[here]], place[at[here]]
            if (place == 0).any():
                state["first"] = logits[:, int(np.flatnonzero(place == 0)[0])].copy()
        if state is not None:
            yield pd.DataFrame(state)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = None
        for now in parts_of(frame):
            if out is None:
                out = now
            else:
                _add(out, now["most"], now["sum"])
                for c in ("own", "first", "y"):
                    out[c] = np.maximum(out[c], now[c])
        whole = np.log(out["sum"]) + out["most"]
        return pd.DataFrame({
            ident: out[ident], "y": out["y"], "loss": whole - out["own"], "top": np.exp(out["most"] - whole),
            "first": np.exp(out["first"] - whole), "total": np.exp(np.log(out["sum"]) + out["most"] - whole),
        })

    done = f"{ident} {kinds[ident]}, y bigint, loss double, top double, first double, total double"
    return against(df.select(ident, vector, label), named, of, schema, rows, classes, merge, done)


def _add(state: dict[str, np.ndarray], most: np.ndarray, total: np.ndarray) -> None:
    """Merges (largest logit, sum relative to it) into a state."""
    top = np.maximum(state["most"], most)
    state["sum"] = state["sum"] * np.exp(state["most"] - top) + total * np.exp(most - top)
    state["most"] = top


def mean_gradient(signals: DataFrame, vector: str = "x", classes: int = 1024, held: int = 4_000_000) -> DataFrame:
    """(place, g, b): for each class its row of the mean gradient of a linear softmax layer, and its bias.

    Tasks add up error^T x for stripes of `classes` classes and hand on rows of one
    class, at most about `held` numbers at a time; those are summed by class.
    """
    schema = "place bigint, g array<double>, b double, n bigint"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            for first, (g, b) in sums.items():
                width = np.arange(0, g.size + 1, g.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first + np.arange(len(b))), pa.ListArray.from_arrays(pa.array(width, pa.int32()), pa.array(g.ravel())), pa.array(b),
                        pa.array(np.zeros(len(b), dtype=np.int64)),
                    ],
                    names=["place", "g", "b", "n"],
                )
            sums.clear()

        for batch in batches:
            for a in range(0, len(batch), 2048):
                some = pa.Table.from_batches([batch.slice(a, 2048)])
                error, x = _errors(matrix(some.column("p")), some.column("y").to_numpy()), matrix(some.column(vector))
                n += len(some)
                for first in range(0, error.shape[1], classes):
                    e = error[:, first : first + classes]
                    g, b = sums.get(first, (0.0, 0.0))
                    sums[first] = g + e.T @ x, b + e.sum(axis=0)
                    if sum(g.size for g, _ in sums.values()) > held:
                        yield from out()
        yield from out()
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1]), pa.array([None], pa.list_(pa.float64())), pa.array([0.0]), pa.array([n])], names=["place", "g", "b", "n"]
        )

    parts = materialise(signals.select(vector, "p", "y").mapInArrow(of, schema))
    rows = float(max(1, parts.agg(F.sum("n")).first()[0] or 0))
    total = parts.filter("place >= 0").groupBy("place").agg(Summarizer.sum(array_to_vector(F.col("g"))).alias("g"), F.sum("b").alias("b"))
    return total.select("place", F.transform(vector_to_array("g"), lambda v: v / rows).alias("g"), (F.col("b") / rows).alias("b"))


def _errors(p, y) -> np.ndarray:
    out = np.array(p, dtype=float)
    out[np.arange(len(out)), np.asarray(y, dtype=int)] -= 1.0
    return out


def grad_alignment(signals: DataFrame, vector: str = "x", ident: str = "id", rows: int = 2048, classes: int = 1024) -> DataFrame:
    """(ident, alignment): cosine of the sample's gradient to the mean gradient, for weights and bias, averaged and mapped to [0, 1].

    The cosine of two outer products needs only e^T G x. G is a table with a row per
    class, and a row's product is a sum over blocks of classes, so no row and no task
    holds all of it.
    """
    mean = mean_gradient(signals, vector, classes)
    kind = dict(signals.dtypes)[ident]

    def of(pairs: Iterator) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for block, some, _, members in pairs:
            if block != last:
                if state is not None:
                    yield pd.DataFrame(state)
                last, x = block, matrix(some.column(vector))
                error = _errors(matrix(some.column("p")), some.column("y").to_numpy())
                size = np.sqrt((error * error).sum(axis=1))
                state = {"block": np.full(len(x), block), ident: some.column(ident).to_numpy(), "w": np.zeros(len(x)), "o": np.zeros(len(x)), "e": size, "x": np.sqrt((x * x).sum(axis=1))}
            e = error[:, members.column("place").to_numpy()]
            state["w"] = state["w"] + (e * (x @ matrix(members.column("g")).T)).sum(axis=1)
            state["o"] = state["o"] + e @ members.column("b").to_numpy()
        if state is not None:
            yield pd.DataFrame(state)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = None
        for now in parts_of(frame):
            out = now if out is None else {**out, "w": out["w"] + now["w"], "o": out["o"] + now["o"]}
        return pd.DataFrame({c: out[c] for c in (ident, "w", "o", "e", "x")})

    done = f"{ident} {kind}, w double, o double, e double, x double"
    summed = against(signals.select(ident, vector, "p", "y"), mean, of, f"block bigint, {done}", rows, classes, merge, done)
    norms = mean.agg(
        F.sqrt(F.sum(V.dot(F.col("g"), F.col("g")))).alias("g"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("b")
    )
    d = summed.withColumn("_m", norms.select(F.struct("g", "b")).scalar())

    def cosine(product, left, right):
        return product / (F.greatest(left, F.lit(1e-8)) * F.greatest(right, F.lit(1e-8)))

    weights, bias = cosine(F.col("w"), F.col("e") * F.col("x"), F.col("_m.g")), cosine(F.col("o"), F.col("e"), F.col("_m.b"))
    return d.select(ident, (((weights + bias) / 2 + 1) / 2).alias("alignment"))


def ensemble_uncertainty(members: DataFrame, ident: str = "id", probs: str = "probs") -> DataFrame:
    """(ident, uncertainty) of a table with a row per sample and ensemble member: the variance over the members, mean over classes.

    Moments per sample and class are partial aggregates, so an ensemble of any
    size never meets in one task. One member alone has no variance: 0.
    """
    each = members.select(ident, F.posexplode(probs).alias("_class", "_p"))
    spread = each.groupBy(ident, "_class").agg(F.coalesce(F.var_samp("_p"), F.lit(0.0)).alias("_v"))
    return spread.groupBy(ident).agg(F.avg("_v").alias("uncertainty"))
