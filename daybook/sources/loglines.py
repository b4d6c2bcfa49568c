"""Log text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_log_lines(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(the columns to keep, ts_text, level, tag, message) of `MM-dd HH:mm:ss.SSS L/tag: message`; a line without a level at its place is a DEBUG one, as of a stack trace."""
    c = F.col(column)
    head = r"^(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) ([DIWE])/([^:]*): ?(.*)$"
    level = F.substring(c, 20, 1)
    shaped = c.rlike(head)
    part = lambda k: F.regexp_extract(c, head, k)
    return lines.select(*(keep or []), F.when(shaped, part(1)).otherwise("").alias("ts_text"), F.when(level.isin("D", "I", "W", "E"), level).otherwise("D").alias("level"), F.when(shaped, part(3)).otherwise("").alias("tag"), F.when(shaped, part(4)).otherwise(c).alias("message"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))
