"""Session settings and the shared work folder."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime settings that every job of this package relies on.  All of them are
# session-scoped SQL settings, so they can be applied to a running session.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Pages are large rows: bound the Arrow batches that feed the HTML parser by
    # bytes and count, so a worker never holds more than a few hundred page trees.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}

# Rows of a task that does CPU-heavy work on each of them.
TASK_ROWS = 20_000

_own_folder: str | None = None
_made: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work (HTML parsing, field rules) at least one partition per core, none of them of many rows.

    A table of few, unsplittable files or row groups would leave most cores idle, and short rows make tasks
    that are small in bytes and long in time: their rows are hashed by a unique key, into as many partitions as
    the rows need.  An input that is dealt well is returned as it is: no shuffle.  For plain scans only;
    the rows of their partitions are counted from the files' footers.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    found = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts, rows, most = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if parts >= slots and most <= 2 * TASK_ROWS:
        return df
    return df.repartition(max(slots, -(-rows // TASK_ROWS)), *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` into several tasks per core, for work whose cost the rows' bytes do not tell.

    Adaptive execution joins small partitions by bytes, which leaves few tasks; a given number it keeps.
    """
    spark = df.sparkSession
    number = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(number, *keys)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    The planner then knows its true size: it broadcasts it below its own
    threshold and shuffles it beyond.  The copy also survives lost executors.  What was shuffled for it is deleted at once.
    """
    path = work_folder(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_slices(rows: DataFrame, by: list[str], most: float, work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``materialized(work(rows), name)``, of slices of about ``most`` of the rows one after the other.

    Rows of equal ``by`` are in one slice.  For work whose shuffles hold much more than the rows: only those of a slice are on disk.
    """
    slices = max(1, math.ceil(rows.count() / max(1, most)))
    if slices == 1:
        return materialized(work(rows), name)
    path = work_folder(rows.sparkSession, name)
    for k in range(slices):
        out = work(rows.where(F.pmod(F.xxhash64(F.lit("slice"), *by), F.lit(slices)) == k))
        _write(out, path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    """Add the rows to the table at ``path``.  Their shuffles go when they are written, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def discard(*tables: DataFrame) -> None:
    """Delete the intermediate tables that these read; nothing may read them any more."""
    for table in tables:
        read = {x.rsplit("/", 2)[-2] for x in table.inputFiles()}
        for path in [x for x in _made if x.rsplit("/", 1)[-1] in read]:
            _made.remove(path)
            _delete(table.sparkSession, path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Where none is named, a
    temporary folder serves in local mode, and a cluster raises an error: its
    executors would each write to a disk of their own.
    """
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folder = _own_folder or tempfile.mkdtemp(prefix="webgrain-")
        base = _own_folder
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables made so far; results that still read them are lost."""
    while _made:
        _delete(spark, _made.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
