"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests, local mode), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows take about so many times the bytes of their Parquet files, where columns hold few different values in runs.
_PACKED = 40


def expect_packed_files(spark: SparkSession) -> None:
    """Let Spark's estimates of tables count with packed files.

    By the sizes of files alone Spark takes tables of millions of short rows for small ones and broadcasts them. What
    it measures while a query runs, and broadcasts that are asked for, are not affected.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < _PACKED:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(_PACKED))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a written table: ends its lineage, so that loops stay short and lost executors cost one round."""
    spark = df.sparkSession
    expect_packed_files(spark)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: Spark leaves a mark there."""
    system, target = _path(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def version(spark: SparkSession, inputs: list[str]) -> str:
    """A digest of the names, sizes, numbers of files and times of change of some files or folders."""
    seen = []
    for name in sorted(inputs):
        system, target = _path(spark, name)
        summary = system.getContentSummary(target)
        seen.append((name, summary.getLength(), summary.getFileCount(), system.getFileStatus(target).getModificationTime()))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:16]


def shared_path(spark: SparkSession, name: str, inputs: list[str]) -> str:
    """The place in the session's shared folder of something made of these inputs as they are now. It goes with the driver."""
    path = f"{shared_dir(spark)}/{name}-{version(spark, inputs)}"
    atexit.register(_delete, spark, path)
    return path


def load_or_create(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; if it isn't there, wasn't written to its end or has no rows, it is made and written first."""
    if complete(spark, path):
        found = spark.read.parquet(path)
        if not found.isEmpty():
            return found
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; otherwise as it is, so that its joins are shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def touching(df: DataFrame, column: str, nodes: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """df without most of its rows whose column is none of nodes (node), so that a join with these shuffles little else.

    Hashes of the nodes are broadcast if they are at most so many; equal hashes of others may stay, which the join drops.
    """
    hashes = nodes.select(F.xxhash64("node").alias("_hash")).distinct()
    if hashes.limit(rows + 1).count() > rows:
        return df
    return df.join(F.broadcast(hashes), F.xxhash64(column) == F.col("_hash"), "left_semi")
