"""Session helpers. A session that runs, or was submitted with settings, is used as it is."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every expression costs more than planning the query.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The plans over pages have more generated classes than the default cache of 100 keeps, and would be
    # compiled again and again by every task.
    "spark.sql.codegen.cache.maxEntries": "4000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "linkloom", cores: str | int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """The active session, untouched; else a new one.

    Master and partitions are set only where they are asked for (tests and bench do) or, for the
    master, where nothing was submitted; a submitted master stays.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("LINKLOOM_DRIVER_MEMORY", "12g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate data that all executors see: in ``spark.checkpoint.dir``, under the
    warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder.

    Used where one result feeds several jobs (model fitting), so that a lost executor does not
    recompute the whole history. A folder of our own is set only where the session names none; Spark
    removes the files with the data where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
