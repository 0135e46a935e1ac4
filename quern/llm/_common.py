"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition used throughout: space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a temporary folder serves only where everything runs in this one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "quern-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder, which every executor shares."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames that are gone: it does so when the driver's garbage is collected, which
    steps of many small exchanges don't bring about by themselves."""
    gc.collect()
    spark._jvm.System.gc()


#: Most bytes of rows handed to a Python worker at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, so that long texts can't fill a worker (a smaller setting of the session's stays)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def tidy(run):
    """run, a function over Arrow batches, that gives freed memory back at its end: idle workers stay alive between stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id):
    """crc32(doc_id as text) mod 3 = 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
