"""Transcription runs and their reports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.textops import is_blank, trimmed
from daybook.functions.timeutil import local_day


def transcribe(segments: DataFrame, fn: Callable[[pd.Series], pd.DataFrame]) -> DataFrame:
    """segments with text (trimmed), lang and took_ms: fn takes payloads and gives those columns. A null payload stays null."""
    heard = F.pandas_udf(fn, "text string, lang string, took_ms long")
    rows = segments.withColumn("_r", heard("payload"))
    return rows.select(*segments.columns, trimmed(F.col("_r.text")).alias("text"), F.coalesce("_r.lang", F.lit("")).alias("lang"), F.col("_r.took_ms").alias("took_ms"))


def to_transcripts(results: DataFrame, zone: str | Column, model: str, now_ms: int) -> DataFrame:
    """Transcript rows of the results with text; day is the local date of the start, created_ms the given time unless it is there."""
    created = F.coalesce("created_ms", F.lit(now_ms)) if "created_ms" in results.columns else F.lit(now_ms)
    rows = results.filter(F.col("text").isNotNull() & ~is_blank(F.col("text")))
    return rows.select("owner_id", F.xxhash64("owner_id", "start_ms", F.lit(model)).alias("id"), "start_ms", "end_ms", local_day(F.col("start_ms"), zone).alias("day"), trimmed(F.col("text")).alias("text"), F.lit(model).alias("model"), F.coalesce("lang", F.lit("")).alias("lang"), created.cast("long").alias("created_ms"))


def run_report(results: DataFrame, remaining: Column | None = None) -> DataFrame:
    """One row: processed, empty, undecryptable, audio_ms, processing_ms, rtf of results (text null where it couldn't be opened)."""
    opened = F.col("text").isNotNull()
    per = results.agg(
        F.count_if(opened).alias("processed"),
        F.count_if(opened & is_blank(F.col("text"))).alias("empty"),
        F.count_if(~opened).alias("undecryptable"),
        F.coalesce(F.sum(F.when(opened, F.col("duration_ms"))), F.lit(0)).alias("audio_ms"),
        F.coalesce(F.sum(F.when(opened, F.col("took_ms"))), F.lit(0)).alias("processing_ms"),
    )
    return per.withColumn("rtf", F.when(F.col("audio_ms") > 0, F.col("processing_ms") / F.col("audio_ms")).otherwise(0.0))


def energy_report(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, samples, avg_ma, mah) of samples (device_id, ts_ms, current_ua) within runs (device_id, run_id, run_start_ms, run_end_ms).

    0 and the smallest int are no readings; the sign doesn't matter; a reading below 1000 already is in mA. The interval
    join has the device and the day as equal keys, so a device's history isn't held in one task.
    """
    day = 86_400_000
    spans = runs.withColumn("slot", F.explode(F.sequence(F.floor(F.col("run_start_ms") / day), F.floor(F.col("run_end_ms") / day))))
    read = samples.filter((F.col("current_ua") != 0) & (F.col("current_ua") != -2147483648)).withColumn("slot", F.floor(F.col("ts_ms") / day))
    size = F.abs("current_ua").cast("double")
    ma = F.when(size / 1000 < 1, size).otherwise(size / 1000)
    inside = read.join(spans, ["device_id", "slot"]).filter("ts_ms BETWEEN run_start_ms AND run_end_ms")
    per = inside.groupBy("run_id", "run_start_ms", "run_end_ms").agg(F.count("*").alias("samples"), F.avg(ma).alias("avg_ma"))
    return per.select("run_id", "samples", "avg_ma", (F.col("avg_ma") * (F.col("run_end_ms") - F.col("run_start_ms")) / 3_600_000).alias("mah"))


def llm_throughput(calls: DataFrame) -> DataFrame:
    """Per run and model: calls, tokens, and tokens per second of prompts and of generation."""
    rate = lambda tokens, ms: F.when(F.col(ms) > 0, F.col(tokens) * 1000 / F.col(ms)).otherwise(0.0)
    per = calls.groupBy("run_id", "model").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "prompt_ms", "gen_tokens", "gen_ms")])
    return per.select("run_id", "model", "calls", "prompt_tokens", "gen_tokens", rate("prompt_tokens", "prompt_ms").alias("prompt_tps"), rate("gen_tokens", "gen_ms").alias("gen_tps"))
