"""Session and scratch storage.

Everything that must outlive the loss of an executor goes to the shared folder
named by ``spark.checkpoint.dir``.  Only a local session without that setting
gets a folder of its own; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, unless ``PYTHONPATH`` does so already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return spark
    folder = tempfile.mkdtemp(prefix="tamiz-code-")
    atexit.register(shutil.rmtree, folder, True)
    # read from here by the driver only, which hands it to the executors
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tamiz", "zip", root, "tamiz"))
    _SHIPPED.add(app)
    return spark


def local_session(cpus: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tamiz")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tamiz-")
        atexit.register(shutil.rmtree, configured, True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_MADE: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the scratch folder; what is written there goes when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clear_scratch)
    _MADE.append((spark, path))
    return path


def clear_scratch() -> None:
    """Delete the scratch tables of this application, also while it runs, if no plan reads them any more."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the scratch folder and read it back.

    Cuts the lineage; the files survive the loss of any executor, and the
    reader knows their size, so that joins choose their strategy by it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is a plain scan and its files make fewer parts than there are cores.

    For steps that cost far more per row than moving the row does.  A plan that
    shuffles already is left as it is.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.outputPartitioning().numPartitions() < cores and df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
