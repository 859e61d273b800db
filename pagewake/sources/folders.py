"""The folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Where a local session without a checkpoint folder, as in tests, puts its checkpoints.
LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables; set as the context's checkpoint folder, if it has none.

    It is the one that spark.checkpoint.dir names. Only a local session, where driver and executors are
    one process, gets a folder of its own; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or LOCAL)
    return sc.getCheckpointDir()
