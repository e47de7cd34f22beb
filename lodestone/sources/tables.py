"""Tables written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark deletes a query's shuffle files at its end instead of when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, a temporary one, on a local master only.

    On a cluster each executor would write to a disk of its own and its rows would be missing later: that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: the master is {master}")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet and read again: they are computed once, and lost executors cost nothing.

    The table stays until ``release``, since a result may be read from it at any time. The shuffle files of the write are
    deleted with its end: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Deletes all durable tables of this application, once its results are written; whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
