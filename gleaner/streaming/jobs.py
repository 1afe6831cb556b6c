"""Starting and finishing streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import scratch_path

STORE = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; the schema comes from the files already there.

    A stream reads folders. The bracket makes the path a pattern with one
    match, so a table that is a single file works as well.
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now, then return the written result as a table.

    The query starts with the state store that stateful processors need; the session's own
    setting is back in place afterwards.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, STATE_STORE)
    try:
        (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
