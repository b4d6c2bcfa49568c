"""Map-reduce of a day: lines to prompts, prompts to digests, digests to one digest."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.timeutil import day_label, hhmm
from daybook.operators.digests import digest_to_json, empty_digest, is_empty, parse_digests, repair_digests
from daybook.operators.summaries import DAY_TOKENS, HOUR_TOKENS, complete, count_words, fallback_day, hour_lines, map_prompts, merge_prompt, pack_lines, plan_summaries
from daybook.schemas import DAY, HOUR, HOUR_MS
from daybook.sources.shared import cut

Llm = Callable[[pd.DataFrame], pd.Series]
RESERVE, LEAST = 400, 512


def input_budget(context: int, system_tokens: int) -> int:
    return max(LEAST, context - DAY_TOKENS - system_tokens - RESERVE)


def _digests(prompts: DataFrame, fn: Llm, max_tokens: Column | int = HOUR_TOKENS) -> DataFrame:
    return repair_digests(parse_digests(cut(complete(prompts, fn, max_tokens=max_tokens)), "raw"), "raw")


def reduce_digests(items: DataFrame, keys: list[str], fn: Llm, budget: int, day: bool, count: Callable[[list[str]], list[int]] = count_words) -> DataFrame:
    """(keys, digest) of items (keys, n, label, text): all keys merge at once, round by round, until each fits one prompt.

    A key whose items need several prompts gets a merged item for each of them and another round; one whose items don't become
    fewer that way is an error, the budget being too small.
    """
    done = None
    while True:
        packs = cut(pack_lines(items, keys, ["n"], "text", budget, count))
        groups = packs.groupBy(*keys, "pack_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("parts"))
        groups = groups.withColumn("n_packs", F.count("*").over(Window.partitionBy(*keys))).join(items.groupBy(*keys).agg(F.first("label").alias("label"), F.count("*").alias("n_items")), keys)
        stuck = groups.filter((F.col("n_packs") > 1) & (F.col("n_packs") >= F.col("n_items")))
        if not stuck.isEmpty():
            raise ValueError("reduce does not converge: budget too small")
        last = F.col("n_packs") == 1
        part_label = F.concat("label", F.lit(", группа "), (F.col("pack_no") + 1).cast("string"))
        prompt = F.when(last, merge_prompt(F.col("label"), F.col("parts"), day)).otherwise(merge_prompt(part_label, F.col("parts"), False))
        merged = cut(_digests(groups.select(*keys, "pack_no", "n_packs", "label", prompt.alias("prompt")), fn, F.when(last, DAY_TOKENS if day else HOUR_TOKENS).otherwise(HOUR_TOKENS)))
        ready = merged.filter("n_packs = 1").select(*keys, "digest")
        done = ready if done is None else done.unionByName(ready)
        more = merged.filter("n_packs > 1")
        if more.isEmpty():
            return done
        text = F.concat(F.lit("Группа "), (F.col("pack_no") + 1).cast("string"), F.lit(": "), digest_to_json(F.coalesce("digest", empty_digest())))
        items = cut(more.select(*keys, F.col("pack_no").alias("n"), "label", text.alias("text")))


def summarize_hours(lines: DataFrame, fn: Llm, budget: int, label: Column, count: Callable[[list[str]], list[int]] = count_words) -> DataFrame:
    """(owner_id, day, period_start_ms, digest) of hour lines: a digest per pack, merged where an hour has several; a failed hour is empty."""
    keys = ["owner_id", "day", "period_start_ms"]
    packs = cut(pack_lines(lines, keys, ["start_ms", "id"], "line", budget, count))
    prompts = map_prompts(packs, keys, label)
    parts = cut(_digests(prompts, fn)).withColumn("digest", F.coalesce("digest", empty_digest())).filter(~is_empty(F.col("digest")))
    counted = parts.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("pack_no"))).withColumn("of", F.count("*").over(Window.partitionBy(*keys)))
    single = counted.filter("of = 1").select(*keys, "digest")
    text = F.concat(F.lit("Часть "), F.col("k").cast("string"), F.lit(": "), digest_to_json(F.col("digest")))
    several = counted.filter("of > 1").select(*keys, F.col("k").cast("long").alias("n"), label.alias("label"), text.alias("text"))
    merged = single if several.isEmpty() else single.unionByName(reduce_digests(several, keys, fn, budget, False, count))
    hours = lines.select(*keys).distinct()
    return hours.join(merged, keys, "left").select(*keys, F.coalesce("digest", empty_digest()).alias("digest"))


def hour_label(day: Column, period_start_ms: Column, zone: str | Column) -> Column:
    return F.concat(hhmm(period_start_ms, zone), F.lit("–"), hhmm(period_start_ms + HOUR_MS, zone), F.lit(", "), day_label(day))


def summarize_days(hours: DataFrame, fn: Llm, budget: int, zone: str | Column, count: Callable[[list[str]], list[int]] = count_words) -> DataFrame:
    """(owner_id, day, digest) of hour digests, in order and labelled; where the model's text can't be read, the digest made without it."""
    keys = ["owner_id", "day"]
    labelled = hours.withColumn("label", hour_label(F.col("day"), F.col("period_start_ms"), zone))
    filled = labelled.filter(~is_empty(F.col("digest")))
    text = F.concat("label", F.lit(": "), digest_to_json(F.col("digest")))
    items = filled.select(*keys, F.col("period_start_ms").alias("n"), F.col("day").alias("label"), text.alias("text"))
    merged = reduce_digests(items, keys, fn, budget, True, count)
    plain = fallback_day(labelled).withColumnRenamed("digest", "plain")
    return hours.select(*keys).distinct().join(merged, keys, "left").join(plain, keys, "left").select(*keys, F.coalesce("digest", "plain", empty_digest()).alias("digest"))


def summarize(transcripts: DataFrame, summaries: DataFrame, fn: Llm, now_ms: int, manual: bool, zone: str | Column, budget: int, model: str = "m", count: Callable[[list[str]], list[int]] = count_words) -> DataFrame:
    """New summary rows of all hours and days that the plan has to do; upsert_summaries puts them in place."""
    plan = cut(plan_summaries(transcripts, summaries, now_ms, manual, zone))
    lines = hour_lines(transcripts, plan, zone)
    hours = cut(summarize_hours(lines, fn, budget, hour_label(F.col("day"), F.col("period_start_ms"), zone), count))
    days = plan.filter((F.col("level") == DAY) & F.col("todo")).select("owner_id", "day")
    stored = repair_digests(parse_digests(summaries.filter(F.col("kind") == HOUR))).select("owner_id", "day", "period_start_ms", "digest")
    known = stored.join(hours.select("owner_id", "day", "period_start_ms"), ["owner_id", "day", "period_start_ms"], "left_anti").filter("digest IS NOT NULL").unionByName(hours)
    day_rows = summarize_days(known.join(days, ["owner_id", "day"], "left_semi"), fn, budget, zone, count)
    made = hours.withColumn("kind", F.lit(HOUR)).unionByName(day_rows.select("owner_id", "day", F.lit(0).cast("long").alias("period_start_ms"), "digest", F.lit(DAY).alias("kind")))
    sources = plan.select("owner_id", "day", "period_start_ms", F.col("level").alias("kind"), F.col("count").alias("source_count"), F.col("max_created_ms").alias("source_max_created_ms"))
    return made.join(sources, ["owner_id", "day", "period_start_ms", "kind"]).select("owner_id", "day", "period_start_ms", "kind", digest_to_json(F.col("digest")).alias("json"), F.lit(model).alias("model"), "source_count", "source_max_created_ms", F.lit(now_ms).cast("long").alias("created_ms"), F.lit(0).cast("long").alias("gen_ms"))
