"""Strata, balanced samples and dataset variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.scale import exact_percentiles, hash_prefix
from gleaner.session import materialise

DISTINCT_VALUES = 1_000_000


def score_bin(score: Column, bins: int) -> Column:
    """Equal-width bin of a score in [0, 1], the top one closed."""
    return F.least(F.floor(score * float(bins)), F.lit(bins - 1)).cast("int")


def quantile_edges(df: DataFrame, value: str, bins: int, distinct: int = DISTINCT_VALUES) -> Column:
    """Array of `bins + 1` linear percentiles, as a scalar subquery.

    Counts per distinct value are taken first, so the percentile works on the
    distinct values (word counts: thousands) and not on the rows. With more than
    `distinct` of them each edge is counted out in its own bucket of values instead.
    """
    points = [i / bins for i in range(bins + 1)]
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    if counts.limit(distinct + 1).count() <= distinct:
        return counts.agg(F.percentile(F.col(value), F.array(*[F.lit(p) for p in points]), F.col("_n"))).scalar()
    return F.array(*[exact_percentiles(df, [], value, p, "_e", distinct).select("_e").scalar() for p in points])


def quantile_bin(df: DataFrame, value: str, bins: int, out: str = "stratum", include_max: bool = False) -> DataFrame:
    """Half-open equal-frequency bins; null for the largest value unless `include_max`."""
    edges = df.withColumn("_edges", quantile_edges(df, value, bins))
    choice = F.when(F.lit(False), 0)
    for i in range(bins):
        lo, hi = F.get("_edges", F.lit(i)), F.get("_edges", F.lit(i + 1))
        choice = choice.when((F.col(value) >= lo) & (F.col(value) < hi), i)
    if include_max:
        choice = choice.when(F.col(value) == F.get("_edges", F.lit(bins)), bins - 1)
    return edges.withColumn(out, choice).drop("_edges")


def stratum_stats(df: DataFrame, kind: str, stratum: str = "stratum", balanced: bool = False) -> DataFrame:
    """One row per stratum next to the totals."""
    sizes = df.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(F.count("*").alias("size"))
    return sizes.select(
        F.lit(kind).alias("type"),
        "stratum",
        "size",
        sizes.agg(F.count("*")).scalar().alias("num_strata"),
        sizes.agg(F.sum("size")).scalar().alias("total_samples"),
        F.lit(balanced).alias("balanced"),
    )


def balanced_sample(
    df: DataFrame, stratum: str, ident: str, seed: int = 0, cap_per_stratum: int | None = None, balanced: bool = True
) -> DataFrame:
    """The same number of rows from each stratum: the size of the smallest one,
    or `cap_per_stratum` where that is given. `balanced=False` keeps all rows."""
    if not balanced:
        return df
    return hash_prefix(df, [stratum], ident, seed, cap_per_stratum)


def strata_columns(df: DataFrame) -> dict[str, Column]:
    """Stratum of each dataset variant as text, over (text, n_words, quality, complexity)."""
    return {
        "quality_stratified": score_bin(F.col("quality"), 10).cast("string"),
        "length_stratified": T.length_band(F.col("n_words")),
        "domain_stratified": T.topic(F.col("text")),
        "complexity_stratified": score_bin(F.col("complexity"), 5).cast("string"),
    }


def variant_catalog(scored: DataFrame, ident: str = "doc_id", seed: int = 0) -> DataFrame:
    """(variant, stratum, id) for the full corpus and its balanced variants.

    A row is expanded to its (variant, stratum) pairs without the text, once; the
    balancing ranks within (variant, stratum) for all variants in one job.
    """
    columns = strata_columns(scored)
    pairs = F.array(*[F.struct(F.lit(v).alias("variant"), s.alias("stratum")) for v, s in columns.items()])
    members = materialise(scored.select(ident, F.inline(pairs)))
    balanced = hash_prefix(members, ["variant", "stratum"], ident, seed, within=["variant"])
    full = members.filter(F.col("variant") == next(iter(columns))).select(
        ident, F.lit("all").alias("stratum"), F.lit("full").alias("variant")
    )
    return full.unionByName(balanced).select("variant", "stratum", ident)


def catalog_metadata(catalog: DataFrame) -> DataFrame:
    """One row per variant: size, number of strata and their sizes as JSON."""
    return (
        catalog.groupBy("variant", "stratum").agg(F.count("*").alias("n"))
        .groupBy("variant")
        .agg(
            F.sum("n").alias("size"),
            F.count("*").alias("num_strata"),
            F.sort_array(F.collect_list(F.struct("stratum", "n"))).alias("s"),
        )
        .select(
            "variant",
            F.when(F.col("variant") == "full", "base").otherwise("stratified").alias("type"),
            "size",
            "num_strata",
            F.to_json(F.map_from_entries("s")).alias("strata_sizes"),
        )
    )
