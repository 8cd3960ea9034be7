"""Session and checkpoint helpers."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "logvigil", **conf: str) -> SparkSession:
    """Session with the settings the library relies on; cluster settings win when already set."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's checkpoint folder so that a lost executor costs no rerun.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local master, as in
    tests on one machine, may leave it unset; a temporary folder is used then.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which the driver and all executors see."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="logvigil-checkpoint-"))
    return (configured or context.getCheckpointDir()).rstrip("/")


def ship_with_tasks(module_name: str) -> None:
    """Send a module's functions inside the tasks, so workers need no installed copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
