"""Logs and artifact files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.operators.buffer import LOG_BYTES, retain_by_size
from daybook.schemas import HOUR_MS

LEVELS = "DIWE"
KEPT_HOURS = 24


def level_number(level: Column) -> Column:
    """D, I, W, E as 1 to 4."""
    return F.instr(F.lit(LEVELS), level)


def filter_logs(logs: DataFrame, least: str, now_ms: int) -> DataFrame:
    """Entries of the level or a graver one, of the last day; restored entries have no time and stay."""
    recent = (F.col("time_ms") == 0) | (F.col("time_ms") >= now_ms - KEPT_HOURS * HOUR_MS)
    return logs.filter((level_number(F.col("level")) >= LEVELS.index(least) + 1) & recent)


def retain_logs(logs: DataFrame, now_ms: int, most: int = LOG_BYTES) -> DataFrame:
    """Entries in the hours of the last day whose sizes, counted from the newest hour, fit. Sizes are summed by hour first."""
    hour = F.floor(F.col("time_ms") / HOUR_MS)
    size = F.octet_length(F.concat_ws("", "level", "tag", "message")) + 22
    hours = logs.select(hour.alias("hour"), size.alias("size")).filter(F.col("hour") >= now_ms // HOUR_MS - KEPT_HOURS).groupBy("hour").agg(F.sum("size").alias("size"))
    kept, _ = retain_by_size(hours.withColumn("all", F.lit(1)), ["all"], [F.desc("hour")], "size", most)
    return logs.withColumn("hour", hour).join(kept.select("hour"), "hour", "left_semi").drop("hour")


def tail_logs(logs: DataFrame, n: int = 3000) -> DataFrame:
    """The last entries; a top-k, not a sort of all."""
    return logs.orderBy(F.desc("seq")).limit(n)


def identify_artifacts(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """files (path, sha256, name) with entry, the catalog id: by hash first, else by name; the first entry of the catalog (ord) wins.

    catalog has one row per file or archive: ord, id, sha256, name (of an archive, the last part of its address). It is small and
    fixed; Spark broadcasts it by its size.
    """
    best = lambda key: catalog.filter(F.col(key).isNotNull()).groupBy((F.lower(key) if key == "sha256" else F.col(key)).alias(f"_{key}")).agg(F.min(F.struct("ord", "id")).alias(f"_by_{key}"))
    told = files.withColumn("_sha256", F.lower("sha256")).join(best("sha256"), "_sha256", "left").withColumn("_name", F.col("name")).join(best("name"), "_name", "left")
    return told.select(*files.columns, F.coalesce(F.col("_by_sha256.id"), F.col("_by_name.id")).alias("entry"), F.when(F.col("_by_sha256").isNotNull(), "hash").when(F.col("_by_name").isNotNull(), "name").alias("matched_by"))
