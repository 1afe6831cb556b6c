"""Sessions, and the shared folder used to cut lineage or write tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gleaner", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    here = str(Path(__file__).resolve().parent.parent)
    if here not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # for the Python processes that the driver starts itself
        os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (here, os.environ.get("PYTHONPATH", "")) if p)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GLEANER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # written frames go with their last reference
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, which import it by name wherever they were started."""
    root = Path(__file__).resolve().parent
    if root.is_dir() and "gleaner.zip" not in [os.path.basename(f) for f in spark.sparkContext.listFiles]:
        archive = Path(tempfile.mkdtemp(prefix="gleaner-code-")) / "gleaner.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, Path(root.name) / source.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if folder:
        if not current.isDefined():
            sc.setCheckpointDir(folder)
        return folder
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gleaner-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table one job writes."""
    return f"{shared_folder(spark).rstrip('/')}/gleaner/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the written copy.

    For narrow frames that several later stages read: they would otherwise
    recompute the scan and the scoring, and a lost executor would make Spark
    redo the whole lineage.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
