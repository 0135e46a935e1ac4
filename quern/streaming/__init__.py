"""Incremental runs over a drop folder: the batch transformation per micro-batch, then the idempotent merge.

An extension; re-delivered rows are harmless because the merge is keyed and idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import merge, refuse_conflicts
from ..session import settled


def one_per_key(rows: DataFrame, keys: list[str], values: list[str], upgradable: list[str] = ()) -> DataFrame:
    """The rows, equal ones once; two rows of a key that differ fail the job, but for blanks of upgradable columns."""

    def value(c):
        told = F.when(F.col(c) != "", F.col(c)) if c in upgradable else F.col(c)
        lone = F.min(told).eqNullSafe(F.max(told)) & (F.lit(True) if c in upgradable else F.count(told).isin(0) | (F.count(told) == F.count(F.lit(1))))
        found = F.coalesce(F.max(told), F.max(c)) if c in upgradable else F.max(c)
        return F.when(lone, found).otherwise(F.raise_error(F.lit(f"conflicting values of {c} for a key")).cast(dict(rows.dtypes)[c])).alias(c)

    return rows.groupBy(*keys).agg(*(value(c) for c in values))


#: Hash buckets of the key: a batch rewrites the buckets that it changes.
BUCKETS = 64


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _published(spark: SparkSession, target: str) -> list[int]:
    at, fs = _files(spark, f"{target}/manifest")
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v")) if fs.exists(at) else []


def _versions(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """bucket -> version by a published manifest: at most as many rows as there are buckets."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{target}/manifest/v{number}").collect()}


def _read(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{target}/data/v{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def _publish(spark: SparkSession, target: str, number: int, versions: dict[int, int]) -> None:
    """The manifest of a batch, under its name by one rename."""
    draft = f"{target}/_draft-v{number}"
    spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(draft)
    (src, fs), (dst, _), (folder, _) = (_files(spark, x) for x in (draft, f"{target}/manifest/v{number}", f"{target}/manifest"))
    fs.mkdirs(folder)
    if not fs.rename(src, dst):
        raise OSError(f"the manifest of batch {number} could not be published")


def merge_batch(spark: SparkSession, rows: DataFrame, number: int, target: str, keys: list[str], values: list[str], upgradable: list[str] = (), buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into target; returns the buckets that it rewrote.

    Only buckets that the batch has keys of are read, and only those in which a row changes are written, under the batch's number; a
    batch whose manifest is there already does nothing.  Two rows of a key that differ are an error, within a batch as well as between them.
    """
    done = _published(spark, target)
    if number in done:
        return []
    before = max((v for v in done if v < number), default=None)
    versions = {} if before is None else _versions(spark, target, before)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = settled(one_per_key(rows, keys, values, upgradable).select(*keys, *values))
    touched = [r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect()]  # at most as many as there are buckets
    old = _read(spark, target, {b: versions[b] for b in touched if b in versions})
    merged = new if old is None else settled(refuse_conflicts(merge(old, new, keys, values, upgradable)).select(*keys, *values))
    changed = merged if old is None else merged.exceptAll(old.select(*keys, *values))
    rewritten = sorted(r.bucket for r in changed.select(bucket.alias("bucket")).distinct().collect())
    if rewritten:
        merged.withColumn("bucket", bucket).where(F.col("bucket").isin(rewritten)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{target}/data/v{number}")
    _publish(spark, target, number, versions | {b: number for b in rewritten})
    return rewritten


def incremental_merge(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], target: str, keys: list[str], values: list[str], checkpoint: str, upgradable: list[str] = ()) -> StreamingQuery:
    """Read new Parquet files of source, transform them, and merge into the buckets below target; returns the query."""

    def step(batch: DataFrame, number: int) -> None:
        merge_batch(batch.sparkSession, transform(batch), number, target, keys, values, upgradable)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last published batch."""
    return _read(spark, target, _versions(spark, target, max(_published(spark, target))))
