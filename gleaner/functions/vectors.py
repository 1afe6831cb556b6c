"""Vector arithmetic on DOUBLE arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once.

    A lambda of a higher-order function evaluates outer expressions again for
    each element; binding them as the variable of a one-element array does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def normalised(v: Column, floor: float = 1e-12) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(
        F.greatest(norm(v), F.lit(floor)), lambda size: F.transform(v, lambda x: x / size)
    )


def argmax(v: Column) -> Column:
    """Zero-based place of the first largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def entropy(p: Column, eps: float = 1e-8) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - x * F.log(x + eps))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def pop_variance(v: Column) -> Column:
    return let(
        mean(v), lambda m: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    ) / F.size(v)


def gradient(v: Column) -> Column:
    """Numerical gradient with unit spacing: one-sided at the ends, central
    inside; zero for a single value."""

    def inner(u: Column) -> Column:
        last = F.size(u) - 1

        def at(i: Column) -> Column:
            return F.get(u, i)

        return F.transform(
            u,
            lambda _, i: F.when(i == 0, at(F.lit(1)) - at(F.lit(0)))
            .when(i == last, at(last) - at(last - 1))
            .otherwise((at(i + 1) - at(i - 1)) / 2),
        )

    return F.when(F.size(v) > 1, let(v, inner)).otherwise(F.array(F.lit(0.0)))
