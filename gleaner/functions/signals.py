"""Scores from class probabilities, losses and gradients.

`p` is the array of class probabilities, `y` the place of the true class in it
and `x` the feature vector. Gradient sizes use the closed form for a linear
softmax layer, (p - onehot(y)) x^T (GraNd / EL2N, Paul et al. 2021).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import vectors as V


def softmax(z: Column) -> Column:
    def shares(e: Column) -> Column:
        return V.let(V.total(e), lambda s: F.transform(e, lambda v: v / s))

    return V.let(
        V.let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))), shares
    )


def uncertainty(p: Column) -> Column:
    return V.entropy(p)


def boundary(p: Column) -> Column:
    return V.let(
        F.sort_array(p, asc=False),
        lambda r: F.exp(-5.0 * (F.get(r, F.lit(0)) - F.get(r, F.lit(1)))),
    )


def confidence_difficulty(p: Column) -> Column:
    return 1.0 - F.array_max(p)


def error(p: Column, y: Column) -> Column:
    """p minus the one-hot vector of the true class."""
    return F.transform(p, lambda v, i: v - (i == y).cast("double"))


def grad_magnitude(p: Column, y: Column, x: Column) -> Column:
    return V.norm(error(p, y)) * V.norm(x)


def grad_norm_sum(p: Column, y: Column, x: Column) -> Column:
    """Sum of the norms for the weights and for the bias, not their root sum."""
    return V.norm(error(p, y)) * (V.norm(x) + 1.0)


def influence(p: Column, y: Column, x: Column) -> Column:
    return F.pow(grad_magnitude(p, y, x), F.lit(2.0))


def hybrid(p: Column, y: Column, x: Column) -> Column:
    return 0.5 * grad_norm_sum(p, y, x) + 0.5 * uncertainty(p)


def cross_entropy(p: Column, y: Column) -> Column:
    return -F.log(F.get(p, y))


def input_gradient(p: Column, y: Column, centroids: Column) -> Column:
    """Gradient size in the features for logits -|x - c_k|^2: 2 |sum_k e_k c_k|.

    The x terms cancel because the errors of a sample add up to zero.
    """
    e = error(p, y)
    size = F.size(F.get(centroids, F.lit(0)))
    zero = F.array_repeat(F.lit(0.0), size)
    weighted = F.zip_with(e, centroids, lambda w, c: F.transform(c, lambda v: v * w))
    summed = F.aggregate(weighted, zero, lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
    return 2.0 * V.norm(summed)
