"""Streams of archives: newly arrived files validated continuously, versions reduced to the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import Corpus

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(archive, modified, content) of files as they appear below ``folder``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("archive"), F.col("modificationTime").alias("modified"), "content")


def validate_stream(archives: DataFrame, reports: str, checkpoint: str, level: str = "references", **trigger) -> StreamingQuery:
    """Writes the report of each arriving archive as Parquet, a folder for each batch; a repeated batch replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        held = rows.select("archive", "content").persist()
        Corpus(held).stored().report(level).write.mode("overwrite").parquet(f"{reports}/batch={number}")
        held.unpersist()

    return archives.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_versions(updates: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The newest update of each key so far: (keys, version, status) from updates (keys, at, version, status).

    A grouped maximum with a watermark on ``at``; run it in update mode.
    """
    return updates.withWatermark("at", delay).groupBy(*keys).agg(F.max(F.struct("at", "version", "status")).alias("last")).select(*keys, "last.version", "last.status")


def run_to_table(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its last result, written as Parquet below ``folder``."""
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/result")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/result")
