"""Column helpers the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of UTF-8 by what the term rule makes of them: letters and digits of ASCII, A-Z in lower case, all others of ASCII a blank.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once: the optimizer may copy a plain expression into every use."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Runs of characters that are not white space; an empty array for null."""
    found = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def terms_of(raw: bytes | None) -> list[bytes]:
    """Runs of letters and digits and of characters beyond ASCII, A-Z in lower case, of a text in UTF-8."""
    return raw.translate(TERM_BYTES).split() if raw else []


def count_of(text: Column, characters: str) -> Column:
    """How many of `characters` the text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def double_array(values: Iterable[float]) -> Column:
    """A literal array as one folded string, instead of one expression per number."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def long_array(values: Iterable[int]) -> Column:
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def remainder(ident: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(ident.cast("string").cast("binary")) % modulus


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files and written copies once the driver has collected the last reference to them. Long jobs ask
    for that between their rounds, so that the disks hold what one round needs and not what all of them made."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sample_by_hash(df: DataFrame, ident: str, rows: int) -> DataFrame:
    """At most `rows` rows, the first in the order of a hash of the id; a partial top-k, no sort of the table."""
    return df.orderBy(F.xxhash64(F.col(ident)), F.col(ident)).limit(rows)


def sample_texts(df: DataFrame, ident: str, rows: int) -> DataFrame:
    """`sample_by_hash` for wide rows: ids are drawn first, so texts outside the sample are not sorted or shuffled."""
    ids = sample_by_hash(df.select(ident), ident, rows)
    return sample_by_hash(df.join(F.broadcast(ids), ident, "left_semi"), ident, rows)


def beside(documents: DataFrame, source: str, build: Callable[[DataFrame], DataFrame], outs: dict[str, str]) -> DataFrame:
    """All columns of `documents` and new ones computed from one of them, whatever names the others have.

    `build` gets a frame with the column `_t` and adds the keys of `outs`; they come
    out under the values, in place of a column of that name.
    """
    keep = [c for c in documents.columns if c not in outs.values()]
    quoted = [F.col(f"`{c}`") for c in keep]
    # always one field, so a frame without other columns has a struct as well
    packed = documents.select(F.struct(F.lit(0).alias("_0"), *[c.alias(f"_{i}_") for i, c in enumerate(quoted)]).alias("_r"), F.col(f"`{source}`").alias("_t"))
    done = build(packed)
    rows = [F.col(f"_r._{i}_").alias(c) for i, c in enumerate(keep)]
    return done.select(*rows, *[F.col(k).alias(v) for k, v in outs.items()])
