"""Run logs, result documents and scalar logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.scale import group_rank, over_history
from gleaner.session import materialise

MANIFEST = "folder string"
KINDS = ("epoch", "strategy", "timing", "coreset")
# Names of the run series that are followed over time.
SERIES = (
    "loss", "train_accuracy", "val_accuracy", "gradient_norm", "learning_rate", "selection_entropy",
)


def append_log(df: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Append records (run, kind, epoch, ts, payload) as one batch; a batch that is written again replaces itself.

    Each batch has a folder of its own, written whole before its name goes into the
    manifest. Readers follow the manifest, so a batch that failed on the way is not
    seen, and one that is repeated, by a retried job or a restarted stream, counts
    once. Without a name the batch is named by its content: the sum of its records' hashes.
    """
    spark = df.sparkSession
    if batch is None:
        record = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(df.columns)])
        parts = df.agg(
            F.count("*"), F.sum(F.xxhash64(record).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), record).cast("decimal(38,0)"))
        ).first()
        batch = hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    folder = f"batch={batch}"
    df.write.mode("overwrite").partitionBy("run", "kind").parquet(f"{path}/data/{folder}")
    written = spark.createDataFrame([(folder,)], MANIFEST).withColumn("written", F.current_timestamp())
    written.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of all batches of the manifest, each batch once. A row of the manifest stands for a batch, not a record."""
    folders = sorted(r[0] for r in spark.read.parquet(f"{path}/manifest").select("folder").distinct().collect())
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in folders])
    return rows.drop("batch")


def run_chunks(log: DataFrame, chunk_records: int = 100_000) -> DataFrame:
    """(run, kind, chunk, records): the records of a run and kind in epoch order, cut into documents of at most `chunk_records`.

    Places come from ranks over buckets, so no task sorts a run and no value holds one,
    however many records it has; a reader goes through the chunks in order.
    """
    ordered = materialise(log.select("run", "kind", "epoch", "ts", "payload").withColumn("_row", F.monotonically_increasing_id()))
    placed = group_rank(ordered, ["run", "kind"], "epoch", "_row").withColumn("chunk", F.floor((F.col("_rank") - 1) / chunk_records))
    record = F.struct("_rank", "epoch", "ts", "payload")
    return placed.groupBy("run", "kind", "chunk").agg(F.sort_array(F.collect_list(record)).alias("r")).select(
        "run", "kind", "chunk", F.transform("r", lambda r: F.struct(r["epoch"].alias("epoch"), r["ts"].alias("ts"), r["payload"].alias("payload"))).alias("records")
    )


def run_summary(log: DataFrame, chunk_records: int = 100_000) -> DataFrame:
    """(run, kind, chunk, document): JSON documents of the records of a run and kind in epoch order, `chunk_records` in each.

    A run of ordinary size has one document for each kind; one of any size has several,
    and none is ever whole in a buffer.
    """
    return run_chunks(log, chunk_records).select("run", "kind", "chunk", F.to_json(F.struct("records")).alias("document"))


def fold_results(flat: DataFrame, chunk_records: int = 100_000) -> DataFrame:
    """Flat rows (run, epoch, series...) to nested result documents: one per run, or several with their first epoch's place."""
    numbered = materialise(flat.select("run", "epoch", "train_loss", "val_loss", "val_accuracy", "strategy").withColumn("_row", F.monotonically_increasing_id()))
    placed = group_rank(numbered, ["run"], "epoch", "_row").withColumn("chunk", F.floor((F.col("_rank") - 1) / chunk_records))
    row = F.struct("_rank", "train_loss", "val_loss", "val_accuracy", "strategy")
    return (
        placed.groupBy("run", "chunk")
        .agg(F.sort_array(F.collect_list(row)).alias("r"))
        .select(
            F.col("run").alias("dataset_name"),
            (F.col("chunk") * chunk_records).alias("first_epoch"),
            F.col("r.train_loss").alias("train_losses"),
            F.col("r.val_loss").alias("val_losses"),
            F.col("r.val_accuracy").alias("val_accuracies"),
            F.col("r.strategy").alias("selection_strategies_used"),
        )
    )


def explode_results(documents: DataFrame) -> DataFrame:
    """Nested result documents to (run, epoch, train_loss, val_loss, val_accuracy, strategy); epochs count from `first_epoch`."""
    series = F.arrays_zip("train_losses", "val_losses", "val_accuracies", "selection_strategies_used")
    return documents.select(
        F.col("dataset_name").alias("run"), F.coalesce("first_epoch", F.lit(0)).alias("_first"), F.posexplode(series).alias("_at", "s")
    ).select(
        "run",
        (F.col("_first") + F.col("_at")).alias("epoch"),
        F.col("s.train_losses").alias("train_loss"),
        F.col("s.val_losses").alias("val_loss"),
        F.col("s.val_accuracies").alias("val_accuracy"),
        F.col("s.selection_strategies_used").alias("strategy"),
    )


def scalar_log(
    df: DataFrame, config: str, order: str, ident: str, scalars: dict[str, Column], step: Column | None = None
) -> DataFrame:
    """Long form (config, step, tag, value); without `step` rows count up per config from 0."""
    if step is None:
        numbered = over_history(
            df, [config], order, ident, 0, lambda d, w: d.withColumn("step", F.col("_rank") - 1)
        )
    else:
        numbered = df.withColumn("step", step)
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), v.cast("double").alias("value")) for t, v in scalars.items()])
    return numbered.select(
        F.col(config).alias("config"), F.col(ident), "step", F.inline(pairs)
    )


def step_key(epoch: Column, batch: Column) -> Column:
    return epoch * 1000 + batch


def route_metrics(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds `kind` (series, reward, usage) and the bare `metric`; drops other names."""
    n = F.col(name)
    kind = (
        F.when(n.isin(*SERIES), "series")
        .when(n.startswith("reward_"), "reward")
        .when(n.startswith("usage_"), "usage")
    )
    return (
        df.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .withColumn("metric", F.when(F.col("kind") == "series", n).otherwise(F.regexp_replace(n, "^(reward|usage)_", "")))
    )
