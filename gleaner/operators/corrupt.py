"""Image corruptions as array expressions: one row in, one row out, no shuffle.

An image is a flat array `px` in (channel, row, column) order with values in
[0, 1]. `s` is the severity (a column). Noise comes from hashes of the image id,
the place and a seed, so a rerun of a lost task gives the same pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import let, mean
from gleaner.operators.sweep import uniform


@dataclass(frozen=True)
class Shape:
    channels: int
    height: int
    width: int

    @property
    def plane(self) -> int:
        return self.height * self.width


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def _normal(ident: Column, i: Column, seed: str) -> Column:
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, "r", ident, i)))
    return radius * F.cos(2 * F.pi() * uniform(seed, "a", ident, i))


def gaussian(px, s, ident, shape):
    return F.transform(px, lambda v, i: clamp(v + 0.1 * s * _normal(ident, i, "gaussian")))


def shot(px, s, ident, shape):
    """Poisson(v * level) / level, clamped.

    The count is the number of k whose cumulative probability the draw reaches.
    Counts from the level on end at 1, so k goes to the level only.
    """
    level = F.lit(s) * 0.1

    def count(rate: Column, draw: Column) -> Column:
        start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0.0).alias("n"))

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * rate / (k + 1)
            reached = F.when(draw >= acc["cdf"], acc["n"] + 1.0).otherwise(acc["n"])
            return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), reached.alias("n"))

        return F.aggregate(F.sequence(F.lit(0), F.ceil(level).cast("int") - 1), start, step, lambda acc: acc["n"])

    return F.transform(px, lambda v, i: F.least(F.lit(1.0), count(v * level, uniform("shot", ident, i)) / level))


def impulse(px, s, ident, shape):
    def hit(v: Column, i: Column) -> Column:
        chosen = uniform("impulse", ident, i) < 0.1 * s
        salted = F.when(chosen & (uniform("salt", ident, i) < 0.5), 1.0).otherwise(v)
        return F.when(chosen & (uniform("pepper", ident, i) >= 0.5), 0.0).otherwise(salted)

    return F.transform(px, hit)


def snow(px, s, ident, shape):
    return F.transform(px, lambda v, i: F.when(uniform("snow", ident, i) < 0.3 * s, 1.0).otherwise(v))


def frost(px, s, ident, shape):
    """Darker, with a lift of the third channel."""
    blue = lambda i: F.floor(i / shape.plane) == 2
    return F.transform(
        px,
        lambda v, i: F.when(blue(i), clamp(v * (1 - 0.2 * s) + 0.2 * s * 0.3)).otherwise(v * (1 - 0.2 * s)),
    )


def fog(px, s, ident, shape):
    return F.transform(px, lambda v: v * (1 - 0.3 * s) + 0.3 * s)


def _factor(s: Column) -> Column:
    return 1.0 + (s - 3) * 0.2


def brightness(px, s, ident, shape):
    return F.transform(px, lambda v: clamp(v * _factor(s)))


def contrast(px, s, ident, shape):
    return let(mean(px), lambda m: F.transform(px, lambda v: clamp((v - m) * _factor(s) + m)))


def jpeg_quantise(px, s, ident, shape):
    step = F.floor(F.lit(256) / F.greatest(F.lit(1), 10 - s * 2))
    return let(step, lambda q: F.transform(px, lambda v: F.floor(F.floor(v * 255) / q) * q / 255.0))


def motion_blur(px, s, ident, shape):
    """Mean over 3 + 2s columns of the same row, zero outside the image."""
    w = shape.width

    def blurred(v: Column, i: Column) -> Column:
        x = i % w
        lo = F.greatest(x - (1 + s), F.lit(0))
        hi = F.least(x + (1 + s), F.lit(w - 1))
        part = F.slice(px, (i - x + lo + 1).cast("int"), (hi - lo + 1).cast("int"))
        return F.aggregate(part, F.lit(0.0), lambda acc, u: acc + u) / (3 + 2 * s)

    return F.transform(px, blurred)


def pixelate(px, s, ident, shape):
    """Nearest down-sampling by s and up-sampling back."""
    def source(position: Column, size: int) -> Column:
        small = F.greatest(F.lit(1), F.floor(F.lit(size) / s))
        shrunk = F.floor(position * small / size)
        return F.floor(shrunk * size / small)

    def value(v: Column, i: Column) -> Column:
        plane, inside = F.floor(i / shape.plane), i % shape.plane
        y, x = F.floor(inside / shape.width), inside % shape.width
        at = plane * shape.plane + source(y, shape.height) * shape.width + source(x, shape.width)
        return F.get(px, at.cast("int"))

    too_small = (s > shape.height) | (s > shape.width)
    return F.when(too_small, px).otherwise(F.transform(px, value))


def cutout(px, ident: Column, shape: Shape, size: int, seed: str = "cutout"):
    """Zero a box of `size` x `size` around a random centre, cut at the border."""
    half = size // 2
    cy = F.floor(uniform(seed, "y", ident) * shape.height)
    cx = F.floor(uniform(seed, "x", ident) * shape.width)

    def covered(centre: Column, position: Column) -> Column:
        return (position >= centre - half) & (position < centre + half)

    def box(y0: Column, x0: Column) -> Column:
        return F.transform(
            px,
            lambda v, i: F.when(
                covered(y0, F.floor((i % shape.plane) / shape.width)) & covered(x0, i % shape.width), 0.0
            ).otherwise(v),
        )

    return let(cy, lambda y: let(cx, lambda x: box(y, x)))


def channel_normalise(px, shape: Shape, means: Sequence[float], stds: Sequence[float]):
    m, d = F.array(*[F.lit(float(v)) for v in means]), F.array(*[F.lit(float(v)) for v in stds])
    channel = lambda i: F.floor(i / shape.plane).cast("int")
    return F.transform(px, lambda v, i: (v - F.get(m, channel(i))) / F.get(d, channel(i)))


CORRUPTIONS: dict[str, Callable] = {
    "gaussian_noise": gaussian,
    "shot_noise": shot,
    "impulse_noise": impulse,
    "snow": snow,
    "frost": frost,
    "fog": fog,
    "brightness": brightness,
    "contrast": contrast,
    "motion_blur": motion_blur,
    "pixelate": pixelate,
    "jpeg_compression": jpeg_quantise,
}


def corrupt_grid(
    images: DataFrame, kinds: Sequence[str], severities: Sequence[int], shape: Shape,
    ident: str = "id", px: str = "px",
) -> DataFrame:
    """One row per (image, kind, severity) with the corrupted `px`.

    The grid is a literal array that each row is expanded by, so the images are
    scanned once for all kinds and nothing is shuffled.
    """
    for kind in kinds:
        if kind not in CORRUPTIONS:
            raise ValueError(f"unknown corruption: {kind}")
    if not all(s >= 1 for s in severities):
        raise ValueError("severities start at 1")
    grid = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity")) for k in kinds for s in severities]
    )
    spread = images.select("*", F.inline(grid))
    choice = F.when(F.lit(False), F.col(px))
    for kind in kinds:
        changed = CORRUPTIONS[kind](F.col(px), F.col("severity"), F.col(ident), shape)
        choice = choice.when(F.col("kind") == kind, changed)
    return spread.withColumn(px, choice)


def as_images(df: DataFrame, vector: str, ident: str) -> DataFrame:
    """Vectors scaled to [0, 1] by the smallest and largest value of all."""
    low = df.agg(F.min(F.array_min(vector))).scalar()
    high = df.agg(F.max(F.array_max(vector))).scalar()
    bounded = df.withColumn("_lo", low.cast("double")).withColumn("_hi", high.cast("double"))
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda v: (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return bounded.select(F.col(ident).alias("id"), scaled.alias("px"))


def pixels(df: DataFrame, shape: Shape, px: str = "px") -> DataFrame:
    """The pixel relation: c, y, x, v per row."""
    kept = [c for c in df.columns if c != px]
    flat = df.select(*kept, F.posexplode(px).alias("i", "v"))
    return flat.select(
        *kept,
        F.floor(F.col("i") / shape.plane).cast("int").alias("c"),
        F.floor((F.col("i") % shape.plane) / shape.width).cast("int").alias("y"),
        (F.col("i") % shape.width).cast("int").alias("x"),
        "v",
    )
