"""Session defaults for single-machine runs; a cluster brings its own settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and with its lineage cut by a reliable checkpoint, for steps that are read several times.

    The folder is the session's spark.checkpoint.dir, which a cluster must set; a temporary one serves only where everything runs in
    this one process.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "quern-checkpoints"))
    return df.checkpoint(eager=True)
