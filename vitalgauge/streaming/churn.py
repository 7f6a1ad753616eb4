"""Churn and co-change as a stream of commit_files; batch and stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sha string, path string, ts long, added long, deleted long"


def read(spark: SparkSession, folder: str, files_each: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)


def churn(changes: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """start, path, changes, added, deleted by event-time window.  A (sha, path) that comes twice
    counts once; the watermark bounds what is remembered for that."""
    rows = changes.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(["sha", "path"])
    out = rows.groupBy(F.window("at", window), "path").agg(F.count("*").alias("changes"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return out.select(F.col("window.start").alias("start"), "path", "changes", "added", "deleted")


def run_once(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Works off what is there, then stops; finished windows are appended."""
    churn(changes).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
