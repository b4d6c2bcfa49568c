"""Counts of each source by owner and day, kept beside the diary, so that nobody scans the sources to find what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.chunks import changed_stats, day_stats

COUNTS = "owner_id STRING, count BIGINT, max_created_ms BIGINT, day STRING, source STRING"


def refresh_day_counts(rows: DataFrame, touched: DataFrame, path: str, source: str) -> None:
    """Counts the days that touched has anew, from the rows of those days alone, and replaces them in the table under path.

    For foreachBatch: rows is the source as it is after the batch, touched the batch. Doing it again changes nothing, and replaced or deleted
    rows are counted as they are then.
    """
    days = [r.day for r in touched.select("day").distinct().collect()]
    if not days:
        return
    fresh = day_stats(rows.filter(F.col("day").isin(days)))
    # a day that lost its last row keeps a row without an owner, which replaces its counts
    empty = rows.sparkSession.createDataFrame([(None, 0, None, d) for d in days], "owner_id string, count long, max_created_ms long, day string")
    both = fresh.select("owner_id", "count", "max_created_ms", "day").unionByName(empty).withColumn("source", F.lit(source))
    both.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "source").parquet(path)


def read_day_counts(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(owner_id, day, count, max_created_ms) of a source."""
    rows = spark.read.schema(COUNTS).parquet(path).filter((F.col("source") == source) & F.col("owner_id").isNotNull())
    return rows.select("owner_id", "day", "count", "max_created_ms")


def days_to_index(spark: SparkSession, path: str, index_days: DataFrame) -> DataFrame:
    """changed_days from the counts alone: the sources aren't read."""
    return changed_stats(read_day_counts(spark, path, "transcripts"), read_day_counts(spark, path, "summaries"), index_days)
