"""Image corruption queries; the vectors of `embeddings` serve as images.

Values are scaled to [0, 1] over the whole table; a vector of 64 is one 8 x 8
image, or a 4 x 4 image of four channels where channels matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import corrupt
from gleaner.plans.base import query
from gleaner.sources.tables import spread, table

GREY = corrupt.Shape(1, 8, 8)
COLOUR = corrupt.Shape(4, 4, 4)
SEVERITIES = (1, 2, 3, 4, 5)
MEANS, STDS = (0.5, 0.45, 0.4, 0.35), (0.25, 0.2, 0.3, 0.15)

# SQL fragments: `px` (id, i from 0, v); `grid` adds the severity s.
PX = """
b AS (SELECT min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings),
px AS (
  SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS i,
    (unnest(embedding)::DOUBLE - lo) / (hi - lo) AS v FROM embeddings, b),
grid AS (SELECT *, i // 8 AS y, i % 8 AS x FROM px, (SELECT unnest(range(1, 6)) AS s))
"""


def images(spark: SparkSession, folder: str) -> DataFrame:
    return corrupt.as_images(spread(table(spark, folder, "embeddings"), "vec_id"), "embedding", "vec_id")


def _u(*parts: str) -> str:
    joined = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({joined}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496)"


def _noise(name: str) -> str:
    return _u(f"'{name}'", "id", "i")


def _clamp(v: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {v}))"


# Per kind: its values over the grid as SQL, and the shape of its images.
GRID_SQL: dict[str, str] = {}
GRID_SHAPE: dict[str, corrupt.Shape] = {}


def _corruption(name: str, kind: str, sql: str | None, shape=GREY, tables: str = "grid"):
    if sql is not None:
        GRID_SQL[kind] = f"SELECT id, s, '{kind}' AS kind, {sql} AS v FROM {tables}"
        GRID_SHAPE[kind] = shape
    text = None if sql is None else (
        f"WITH {PX} SELECT id, s::INT AS severity, i::INT AS i, round({sql}, 6) AS v FROM {tables}"
    )

    @query(name, text)
    def run(spark, folder):
        grid = corrupt.corrupt_grid(images(spark, folder), [kind], SEVERITIES, shape)
        return grid.select("id", "severity", F.posexplode("px").alias("i", "v")).withColumn("v", F.round("v", 6))

    return run


_corruption(
    "corrupt_gaussian", "gaussian_noise",
    _clamp(
        f"v + 0.1::DOUBLE * s * (sqrt(-2 * ln(1 - {_u(chr(39) + 'gaussian' + chr(39), chr(39) + 'r' + chr(39), 'id', 'i')}))"
        f" * cos(2 * pi() * {_u(chr(39) + 'gaussian' + chr(39), chr(39) + 'a' + chr(39), 'id', 'i')}))"
    ),
)
_corruption(
    "corrupt_shot", "shot_noise",
    f"""{_clamp(f'''(list_sum(list_transform(range(0, 20), lambda n: ({_noise('shot')} >=
      list_sum(list_transform(range(0, n + 1), lambda k: exp(-v * 0.1::DOUBLE * s) * pow(v * 0.1::DOUBLE * s, k) / gamma(k + 1))))::INT)))
      / (0.1::DOUBLE * s)''')}""",
)
_corruption(
    "corrupt_impulse", "impulse_noise",
    f"""CASE WHEN {_noise('impulse')} < 0.1::DOUBLE * s AND {_noise('pepper')} >= 0.5 THEN 0.0::DOUBLE
      WHEN {_noise('impulse')} < 0.1::DOUBLE * s AND {_noise('salt')} < 0.5 THEN 1.0::DOUBLE ELSE v END""",
)
_corruption("corrupt_snow", "snow", f"CASE WHEN {_noise('snow')} < 0.3::DOUBLE * s THEN 1.0::DOUBLE ELSE v END")
_corruption(
    "corrupt_frost", "frost",
    f"""CASE WHEN i // 16 = 2 THEN {_clamp("v * (1 - 0.2::DOUBLE * s) + 0.2::DOUBLE * s * 0.3::DOUBLE")}
      ELSE v * (1 - 0.2::DOUBLE * s) END""",
    COLOUR,
)
_corruption("corrupt_fog", "fog", "v * (1 - 0.3::DOUBLE * s) + 0.3::DOUBLE * s")
_corruption("corrupt_brightness", "brightness", _clamp("v * (1 + (s - 3) * 0.2::DOUBLE)"))
_corruption(
    "corrupt_contrast", "contrast",
    _clamp("(v - m) * (1 + (s - 3) * 0.2::DOUBLE) + m"),
    tables="(SELECT *, avg(v) OVER (PARTITION BY id, s) AS m FROM grid)",
)
_corruption(
    "corrupt_jpeg_quantise", "jpeg_compression",
    "floor(floor(v * 255) / (256 // greatest(1, 10 - 2 * s))) * (256 // greatest(1, 10 - 2 * s)) / 255",
)
_corruption(
    "corrupt_motion_blur", "motion_blur",
    "m",
    tables="""(SELECT a.id, a.s, a.i, sum(b.v) / (3 + 2 * a.s) AS m FROM grid a JOIN grid b
      ON a.id = b.id AND a.s = b.s AND a.y = b.y AND abs(a.x - b.x) <= 1 + a.s GROUP BY a.id, a.s, a.i)""",
)


def _source(p: str) -> str:
    return f"((({p} * (8 // g.s)) // 8) * 8 // (8 // g.s))"


_corruption(
    "corrupt_pixelate", "pixelate",
    "w",
    tables=f"(SELECT g.id, g.s, g.i, p.v AS w FROM grid g JOIN px p ON p.id = g.id AND p.i = {_source('g.y')} * 8 + {_source('g.x')})",
)


@query(
    "corrupt_grid",
    f"""WITH {PX}, t AS ({" UNION ALL ".join(GRID_SQL.values())})
    SELECT id, kind, s::INT AS severity, round(avg(v), 6) AS mean, round(max(v), 6) AS top FROM t GROUP BY id, kind, s""",
)
def corrupt_grid(spark, folder):
    """All kinds at all severities, summarised per image; one scan for each shape of images."""
    total = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
    found = None
    for shape in dict.fromkeys(GRID_SHAPE.values()):
        kinds = [k for k, own in GRID_SHAPE.items() if own == shape]
        grid = corrupt.corrupt_grid(images(spark, folder), kinds, SEVERITIES, shape).select(
            "id", "kind", "severity", F.round(total / F.size("px"), 6).alias("mean"), F.round(F.array_max("px"), 6).alias("top")
        )
        found = grid if found is None else found.union(grid)
    return found


@query(
    "cutout",
    f"""WITH {PX}, c AS (SELECT *, i // 8 AS y, i % 8 AS x, floor({_u("'cutout'", "'y'", "id")} * 8) AS cy, floor({_u("'cutout'", "'x'", "id")} * 8) AS cx FROM px)
    SELECT id, 0 AS c, y::INT AS y, x::INT AS x,
      round(CASE WHEN y >= cy - 2 AND y < cy + 2 AND x >= cx - 2 AND x < cx + 2 THEN 0.0::DOUBLE ELSE v END, 6) AS v FROM c""",
)
def cutout(spark, folder):
    boxed = images(spark, folder).select("id", corrupt.cutout(F.col("px"), F.col("id"), GREY, 4).alias("px"))
    return corrupt.pixels(boxed, GREY).withColumn("v", F.round("v", 6))


@query(
    "channel_normalise",
    f"""WITH {PX} SELECT id, i::INT AS i, round((v - ({list(MEANS)}::DOUBLE[])[i // 16 + 1]) / ({list(STDS)}::DOUBLE[])[i // 16 + 1], 6) AS v FROM px""",
)
def channel_normalise(spark, folder):
    scaled = images(spark, folder).select("id", corrupt.channel_normalise(F.col("px"), COLOUR, MEANS, STDS).alias("px"))
    return scaled.select("id", F.posexplode("px").alias("i", "v")).withColumn("v", F.round("v", 6))
