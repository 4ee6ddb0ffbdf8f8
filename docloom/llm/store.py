"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir.

    Only where the setting is missing (local tests) a folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/docloom-shared"
    return base.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/docloom/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs its own tasks, not the steps before.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system interface."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, through Hadoop's file system interface."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return


#: A side of a join is broadcast up to this many rows and bytes of its files. Beyond the bytes, but
#: not the rows, its keys alone are; beyond the rows, the join is shuffled.
SMALL_ROWS, SMALL_BYTES = 500_000, 6 << 20


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a folder, through Hadoop's file system interface."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(where).getLength()


def join_small(left: DataFrame, right: DataFrame, key: Column, right_key: str, how: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """left joined (inner or left) with a staged table on a key that is unique and not null there.

    Rows of left are long texts. Where the keys are few, only rows that have a match are shuffled.
    """
    on = key == F.col(right_key)
    if right.count() > SMALL_ROWS:
        return left.join(right, on, how)
    files = right.inputFiles()
    if not files or size_of(left.sparkSession, files[0].rpartition("/")[0]) <= small_bytes:
        return left.join(F.broadcast(right), on, how)
    keys = F.broadcast(right.select(F.col(right_key).alias("_few")))
    hit = left.join(keys, key == F.col("_few"), "left_semi").join(right.hint("merge"), on, "inner")
    if how == "inner":
        return hit
    return hit.unionByName(left.join(keys, key == F.col("_few"), "left_anti"), allowMissingColumns=True)
