"""Frame telemetry: levels, windows, changes, silence, speech by hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.timeutil import hour_start
from daybook.operators.ordered import HOUR_MS, running_sums, with_previous

SILENCE_DB, RATE = -96.0, 16_000


def frame_level(df: DataFrame, pcm: str = "pcm") -> DataFrame:
    """df with dbfs (-96 to 0) and all_zero of the samples."""
    squares = F.aggregate(pcm, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rms = F.sqrt(squares / F.when(F.size(pcm) > 0, F.size(pcm)))
    level = F.when(rms > 0, F.greatest(F.lit(SILENCE_DB), F.least(F.lit(0.0), F.log10(rms / 32767) * 20))).otherwise(SILENCE_DB)
    return df.withColumn("dbfs", level).withColumn("all_zero", F.forall(pcm, lambda x: x == 0))


def capture_windows(frames: DataFrame, window: str = "60 seconds", rate: int = RATE) -> DataFrame:
    """Per owner and window: frames, audio_ms, screen_off_ms, silenced_ms, zero_frames, avg_dbfs, coverage. Batch and stream alike.

    A stream needs its watermark on ts set by the caller; a batch gets ts from frame_start_ms.
    """
    df = frames if "ts" in frames.columns else frames.withColumn("ts", F.timestamp_millis("frame_start_ms"))
    ms = lambda c: F.floor(F.sum(c) * 1000 / rate).cast("long")
    samples = F.col("n_samples")
    per = df.groupBy("owner_id", F.window("ts", window).alias("w")).agg(
        F.count("*").alias("frames"),
        ms(samples).alias("audio_ms"),
        ms(F.when(~F.col("screen_on"), samples).otherwise(0)).alias("screen_off_ms"),
        ms(F.when(F.col("silenced"), samples).otherwise(0)).alias("silenced_ms"),
        F.count_if("all_zero").alias("zero_frames"),
        F.avg("dbfs").alias("avg_dbfs"),
    )
    wall = F.unix_millis("w.end") - F.unix_millis("w.start")
    return per.select("owner_id", F.unix_millis("w.start").alias("window_ms"), "frames", "audio_ms", "screen_off_ms", "silenced_ms", "zero_frames", F.coalesce("avg_dbfs", F.lit(SILENCE_DB)).alias("avg_dbfs"), F.when(wall > 0, F.col("audio_ms") / wall).otherwise(0.0).alias("coverage"))


def coverage_alerts(windows: DataFrame, least: float = 0.95) -> DataFrame:
    return windows.filter((F.col("coverage") < least) | (F.col("silenced_ms") > 0))


def state_changes(df: DataFrame, columns: tuple[str, ...] = ("screen_on", "silenced")) -> DataFrame:
    """Rows where one of the columns differs from the owner's row before."""
    rows = with_previous(df, ["frame_no", *columns], ["frame_start_ms", "frame_no"])
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"previous.{c}"))
    return rows.filter(F.col("previous").isNotNull() & changed).drop("previous")


def is_silent() -> Column:
    """What the system silenced, or what is at the floor."""
    return F.coalesce(F.col("silenced") | (F.col("dbfs") <= SILENCE_DB), F.lit(False))


def frame_end() -> Column:
    return F.col("frame_start_ms") + F.floor(F.col("n_samples") * 1000 / RATE)


def silence_runs(df: DataFrame, min_ms: int = 10_000) -> DataFrame:
    """(owner_id, start_ms, end_ms, n_frames, alarm): runs of frames that the system silenced or that are at the floor; one alarm a run.

    Runs are found hour by hour, the loud ones too. Those within an hour are whole; of each hour the first and the last one are joined with their neighbours.
    """
    rows = df.select("owner_id", "frame_no", "frame_start_ms", frame_end().alias("end_ms"), is_silent().alias("silent"), F.floor(F.col("frame_start_ms") / HOUR_MS).alias("hour"))
    w = Window.partitionBy("owner_id", "hour").orderBy("frame_start_ms", "frame_no")
    marked = rows.withColumn("new", (~F.col("silent").eqNullSafe(F.lag("silent").over(w))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("owner_id", "hour", "run").agg(F.first("silent").alias("silent"), F.min("frame_start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_frames"))
    of_hour = Window.partitionBy("owner_id", "hour")
    runs = runs.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(of_hour)))
    along = Window.partitionBy("owner_id").orderBy("hour", "run")
    goes_on = F.col("silent").eqNullSafe(F.lag("silent").over(along)) & (F.col("hour") != F.lag("hour").over(along))
    edges = runs.filter("edge").withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).filter("silent")
    joined = edges.groupBy("owner_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_frames").alias("n_frames"))
    found = joined.drop("island").unionByName(runs.filter("silent AND NOT edge").select("owner_id", "start_ms", "end_ms", "n_frames"))
    return found.select("owner_id", "start_ms", "end_ms", "n_frames", (F.col("end_ms") - F.col("start_ms") > min_ms).alias("alarm"))


def hourly_speech(frames: DataFrame, segments: DataFrame, zone: str | Column, rate: int = RATE) -> DataFrame:
    """Per owner and local hour with audio: audio_ms, speech_ms, segments, dropped_short, speech_share.

    segments are rows of segment_speech, dropped ones too; each counts in the hour of the frame that closed it.
    """
    per = lambda c: hour_start(F.col(c), zone).alias("hour_ms")
    audio = frames.groupBy("owner_id", per("frame_start_ms")).agg(F.floor(F.sum("n_samples") * 1000 / rate).cast("long").alias("audio_ms"))
    speech = segments.groupBy("owner_id", per("close_ms")).agg(
        F.sum(F.when(~F.col("dropped"), F.col("n_frames") * 32).otherwise(0)).alias("speech_ms"), F.count_if(~F.col("dropped")).alias("segments"), F.count_if("dropped").alias("dropped_short")
    )
    both = audio.join(speech, ["owner_id", "hour_ms"], "left").fillna(0, ["speech_ms", "segments", "dropped_short"])
    return both.withColumn("speech_share", F.when(F.col("audio_ms") > 0, F.col("speech_ms") / F.col("audio_ms")).otherwise(0.0))


def session_totals(segments: DataFrame) -> DataFrame:
    """segments with running totals of speech and segments of the owner: within days, plus the days before."""
    return running_sums(segments, "start_ms", {"total_speech_ms": F.col("n_frames") * 32, "total_segments": F.lit(1)})
