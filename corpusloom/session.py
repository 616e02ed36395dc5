"""Session helpers shared by operators, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_PARENT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE and Arrow."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when they share the driver's file system.

    On a cluster the package is shipped with ``--py-files`` instead; the extra entry does no harm there.
    """
    env = spark.sparkContext.environment
    if PACKAGE_PARENT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGE_PARENT, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint folder exists (tests on one machine) a local folder is made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{shared}")
    return shared


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def saved(df: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (at ``path``, else a new one) and read it back.

    It cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and gives the
    planner the true size of the table.
    """
    path = path or scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` dealt over all cores, four parts each, before a step that takes long for a row: small files are few tasks."""
    return df.repartition(4 * spark.sparkContext.defaultParallelism)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that ``saved`` wrote and that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
