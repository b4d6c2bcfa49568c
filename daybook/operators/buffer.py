"""The segment buffer: what waits, how much there is, what may stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of segments and of logs that are kept.
SEGMENT_BYTES, LOG_BYTES = 2 << 30, 5 << 20
#: File extensions of audio.
AUDIO = "bseg pcm wav raw m4a ogg opus mp3 aac 3gp amr flac".split()


def pending_segments(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments without a result, the oldest first. A blank or undecryptable result is one too."""
    return segments.join(results.select("owner_id", "start_ms").distinct(), ["owner_id", "start_ms"], "left_anti").orderBy("owner_id", "start_ms")


def buffer_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("owner_id").agg(F.count("*").alias("segments"), F.sum("duration_ms").alias("duration_ms"), F.sum("size").alias("bytes"))


def retain_by_size(df: DataFrame, part: list[str], order: list[Column | str], size: str, most: int, block: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): of each part the newest rows whose sizes add up to `most` at most, the newest one always. order names the newest first.

    With `block`, a number that never grows along the order (a day of a time that comes first in it), sizes are summed by block, and rows are put in order within
    their block alone: a part of very many rows is spread over tasks.
    """
    rows = df.withColumn("_block", F.lit(0) if block is None else block)
    sums = rows.groupBy(*part, "_block").agg(F.sum(size).alias("_all"))
    newer = Window.partitionBy(*part).orderBy(F.desc("_block"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_all").over(newer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_newest", F.row_number().over(newer) == 1)
    w = Window.partitionBy(*part, "_block").orderBy(*order)
    met = rows.join(sums.select(*part, "_block", "_before", "_newest"), [*part, "_block"])
    marked = met.withColumn("_sum", F.col("_before") + F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    stays = (F.col("_sum") <= most) | (F.col("_newest") & (F.col("_n") == 1))
    return marked.filter(stays).select(df.columns), marked.filter(~stays).select(df.columns)


def leftover_audio(files: DataFrame, models: str = "/models/") -> DataFrame:
    """(class, files) of a listing (path): "pending" segments, and "stray" audio anywhere but in the models' folder."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    in_segments = F.col("path").rlike(r"(^|/)segments/[^/]*$")
    kind = F.when((ext == "bseg") & in_segments, "pending").when(ext.isin(AUDIO) | F.lower(name).endswith(".bseg.tmp"), "stray")
    rows = files.filter(~F.col("path").contains(models)).select(kind.alias("class")).filter("class IS NOT NULL")
    return rows.groupBy("class").agg(F.count("*").alias("files"))
