"""The diary by day: overviews, lines, digests beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.timeutil import hhmm, hour_start
from daybook.operators.digests import parse_digests
from daybook.schemas import DAY, HOUR


def day_overview(transcripts: DataFrame) -> DataFrame:
    """Per owner and day: segments, speech_ms, first_ms, last_ms; the newest day first."""
    return transcripts.groupBy("owner_id", "day").agg(F.count("*").alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms")).orderBy("owner_id", F.desc("day"))


def day_transcripts(transcripts: DataFrame, days: list[str]) -> DataFrame:
    """Rows of the days, in order. The filter on day prunes partitions of a table that write_day wrote."""
    return transcripts.filter(F.col("day").isin(days)).orderBy("owner_id", "start_ms", "id")


def timeline(transcripts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Day overview beside the parsed day digest; a digest that can't be parsed, or none, is null."""
    digests = parse_digests(summaries.filter(F.col("kind") == DAY)).select("owner_id", "day", "digest")
    return day_overview(transcripts).join(digests, ["owner_id", "day"], "left")


def line_text(text: Column, start_ms: Column, zone: str | Column) -> Column:
    return F.concat(F.lit("["), hhmm(start_ms, zone), F.lit("] "), text)


def day_detail(transcripts: DataFrame, summaries: DataFrame, zone: str | Column) -> DataFrame:
    """Per owner, day and local hour: lines ([HH:mm] text, in order), their count, and the hour's digest."""
    lines = transcripts.withColumn("period_start_ms", hour_start(F.col("start_ms"), zone)).withColumn("line", line_text(F.col("text"), F.col("start_ms"), zone))
    hours = lines.groupBy("owner_id", "day", "period_start_ms").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "id", "line"))), lambda x: x["line"]).alias("lines"), F.count("*").alias("n_lines"))
    digests = parse_digests(summaries.filter(F.col("kind") == HOUR)).select("owner_id", "day", "period_start_ms", "digest")
    return hours.join(digests, ["owner_id", "day", "period_start_ms"], "left").orderBy("owner_id", "day", "period_start_ms")


def purge_before(transcripts: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Rows from the day on, and the number of those before it by owner."""
    return transcripts.filter(F.col("day") >= day), transcripts.filter(F.col("day") < day).groupBy("owner_id").agg(F.count("*").alias("purged"))


def transcript_count(transcripts: DataFrame) -> DataFrame:
    return transcripts.agg(F.count("*").alias("transcripts"))
