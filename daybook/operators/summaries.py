"""What has to be summarized, and the pieces of summarizing it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.textops import is_blank
from daybook.functions.timeutil import day_end, hour_start
from daybook.operators.digests import LISTS, is_empty
from daybook.operators.ordered import dealt
from daybook.operators.timeline import line_text
from daybook.schemas import DAY, HOUR, HOUR_MS

MAX_ITEMS, MAX_MOODS = 10, 3


def plan_summaries(transcripts: DataFrame, summaries: DataFrame, now_ms: int, manual: bool, zone: str | Column) -> DataFrame:
    """(owner_id, day, level, period_start_ms, count, max_created_ms, todo) for every hour and day with transcripts.

    An hour is to do when it is over, or on a manual run, and its stored counts differ; a day when it is over, no hour of it is
    still open, and its counts differ. So late transcripts reopen both. Hours of a day whose digest is fresh aren't planned.
    """
    t = transcripts.select("owner_id", "day", hour_start(F.col("start_ms"), zone).alias("hour_ms"), "created_ms")
    sets = t.groupingSets([["owner_id", "day", "hour_ms"], ["owner_id", "day"]], "owner_id", "day", "hour_ms").agg(F.grouping_id().alias("g"), F.count("*").alias("count"), F.max("created_ms").alias("max_created_ms"))
    level = F.when(F.col("g") == 0, HOUR).otherwise(DAY)
    sources = sets.select("owner_id", "day", level.alias("level"), F.when(F.col("g") == 0, F.col("hour_ms")).otherwise(0).alias("period_start_ms"), "count", "max_created_ms")
    stored = summaries.select("owner_id", "day", "period_start_ms", F.col("source_count").alias("_n"), F.col("source_max_created_ms").alias("_m"))
    both = sources.join(stored, ["owner_id", "day", "period_start_ms"], "left")
    fresh = F.col("count").eqNullSafe(F.col("_n")) & F.col("max_created_ms").eqNullSafe(F.col("_m"))
    over = F.lit(manual) | F.when(F.col("level") == HOUR, F.col("period_start_ms") + HOUR_MS <= now_ms).otherwise(day_end(F.col("day"), zone) <= now_ms)
    of_day = Window.partitionBy("owner_id", "day")
    told = both.select("*", fresh.alias("fresh"), over.alias("over")).select(
        "*",
        F.bool_or((F.col("level") == HOUR) & ~F.col("over")).over(of_day).alias("open"),
        F.bool_or((F.col("level") == DAY) & F.col("fresh")).over(of_day).alias("settled"),
    )
    todo = F.col("over") & ~F.col("fresh") & F.when(F.col("level") == DAY, ~F.col("open")).otherwise(F.lit(True)) & ~F.col("settled")
    return told.select("owner_id", "day", "level", "period_start_ms", "count", "max_created_ms", todo.alias("todo"))


def drop_stale_hours(summaries: DataFrame, plan: DataFrame) -> DataFrame:
    """summaries without hours of planned days that have no transcripts any more."""
    hours = plan.filter(F.col("level") == HOUR).select("owner_id", "day", "period_start_ms")
    planned = plan.select("owner_id", "day").distinct()
    stale = summaries.filter(F.col("kind") == HOUR).join(planned, ["owner_id", "day"], "left_semi").join(hours, ["owner_id", "day", "period_start_ms"], "left_anti").select("owner_id", "day", "period_start_ms")
    return summaries.join(stale, ["owner_id", "day", "period_start_ms"], "left_anti")


def upsert_summaries(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """existing with the rows of updates in place of those of the same owner, day and period."""
    return existing.join(updates, ["owner_id", "day", "period_start_ms"], "left_anti").unionByName(updates)


def hour_lines(transcripts: DataFrame, plan: DataFrame, zone: str | Column) -> DataFrame:
    """(owner_id, day, period_start_ms, start_ms, id, line) of the hours that are to do."""
    todo = plan.filter((F.col("level") == HOUR) & F.col("todo")).select("owner_id", "day", "period_start_ms")
    rows = transcripts.withColumn("period_start_ms", hour_start(F.col("start_ms"), zone)).join(todo, ["owner_id", "day", "period_start_ms"], "left_semi")
    return rows.select("owner_id", "day", "period_start_ms", "start_ms", "id", line_text(F.col("text"), F.col("start_ms"), zone).alias("line"))


def count_words(texts: list[str]) -> list[int]:
    """A stand-in for a tokenizer."""
    return [len(t.split()) for t in texts]


def _pieces(line: str, budget: int, count: Callable[[list[str]], list[int]]) -> list[str]:
    """The line, or greedy pieces of its words that fit the budget; a word beyond it stays alone."""
    if count([line])[0] + 1 <= budget:
        return [line]
    out: list[str] = []
    for word in line.split(" "):
        if out and out[-1] and count([f"{out[-1]} {word}"])[0] + 1 <= budget:
            out[-1] += f" {word}"
        elif out and not out[-1]:
            out[-1] = word
        else:
            out.append(word)
    return [p for p in out if p]


def pack_lines(df: DataFrame, keys: list[str], order: list[str], text: str, budget: int, count: Callable[[list[str]], list[int]] = count_words) -> DataFrame:
    """(keys, pack_no, line_no, text): each key's lines in order, packed greedily to the budget; a line costs its tokens and one more.

    Keys are dealt over tasks; a task goes through its sorted lines batch by batch and remembers how full the pack is, so a key may have any number of lines.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pack, line_no, used = None, 0, 0, 0
        for batch in batches:
            of = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            pieces = [(row, p) for row, line in enumerate(batch.column(text).to_pylist()) for p in _pieces(line or "", budget, count)]
            packs, places = [], []
            for (row, _), cost in zip(pieces, count([p for _, p in pieces]) if pieces else [], strict=True):
                if here is None or of[row] != here:
                    here, pack, line_no, used = of[row], 0, 0, 0
                elif used + cost + 1 > budget:
                    pack, line_no, used = pack + 1, 0, 0
                packs.append(pack)
                places.append(line_no)
                line_no, used = line_no + 1, used + cost + 1
            own = batch.select(keys).take(pa.array([row for row, _ in pieces], pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(packs, pa.int64()), pa.array(places, pa.int64()), pa.array([p for _, p in pieces], pa.string())], [*keys, "pack_no", "line_no", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pack_no long, line_no long, text string"
    rows = df.select(*dict.fromkeys([*keys, *order, text]))
    return dealt(rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: What the model is told before every prompt, and the texts around the lines and digests of a prompt.
SYSTEM = """Ты ведёшь личный дневник владельца телефона. Тебе дают автоматическую расшифровку его разговоров за период:
текст без пунктуации, с ошибками распознавания; рядом могут говорить другие люди, телевизор или радио.
Составь краткую точную выжимку на русском языке. Не выдумывай ничего, чего нет в тексте. Имена, числа, даты
и сроки переноси точно. Если для категории ничего нет — пустой список. Отвечай только JSON."""
FIELDS = """Поля JSON:
summary — 2–4 предложения: что происходило;
events — события и встречи (с временем, если понятно);
agreements — договорённости и обещания: кто, кому, что и к какому сроку;
tasks — задачи и дела, которые нужно сделать;
ideas — идеи и мысли, которые стоит запомнить;
mood — настроение и тон одним-тремя словами.
В каждом списке не больше 7 пунктов, каждый пункт — одна короткая фраза."""
MAP_HEAD = "Расшифровка (время — начало фразы):"
MERGE_DAY = "Ниже выжимки по часам. Составь итог дня: summary — 4–6 предложений о дне в целом, в остальных полях — объединённые списки без повторов, самое важное первым."
MERGE_PARTS = "Ниже выжимки частей одного периода. Объедини их в одну выжимку без повторов."


def map_prompts(packs: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """(keys, pack_no, n_packs, prompt): the part's number is told only if there are several."""
    per = packs.groupBy(*keys, "pack_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("lines"), F.first(label).alias("label"))
    per = per.withColumn("n_packs", F.count("*").over(Window.partitionBy(*keys)))
    part = F.when(F.col("n_packs") > 1, F.concat(F.lit(", часть "), (F.col("pack_no") + 1).cast("string"), F.lit(" из "), F.col("n_packs").cast("string"))).otherwise("")
    return per.select(*keys, "pack_no", "n_packs", F.concat(F.lit("Период: "), "label", part, F.lit(f".\n{MAP_HEAD}\n"), "lines", F.lit(f"\n\n{FIELDS}")).alias("prompt"))


def merge_prompt(label: Column, parts: Column, day: bool) -> Column:
    head = F.concat(F.lit("День: " if day else "Период: "), label, F.lit(f". {MERGE_DAY if day else MERGE_PARTS}\n"))
    return F.concat(head, F.array_join(parts, "\n"), F.lit(f"\n\n{FIELDS}"))


#: Tokens that a model may put out for a period, and for a day, which merges many.
HOUR_TOKENS, DAY_TOKENS = 700, 1400


def complete(prompts: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], partitions: int | None = None, system: str = SYSTEM, max_tokens: Column | int = HOUR_TOKENS, temperature: float = 0.0) -> DataFrame:
    """prompts with raw: fn takes frames of requests (system, prompt, max_tokens, temperature) and gives the model's texts.

    With `partitions`, prompts are dealt out evenly, as calls take seconds each.
    """
    rows = prompts.repartition(partitions) if partitions else prompts
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    request = F.struct(F.lit(system).alias("system"), F.col("prompt").alias("prompt"), limit.cast("int").alias("max_tokens"), F.lit(float(temperature)).alias("temperature"))
    return rows.withColumn("raw", F.pandas_udf(fn, "string")(request))


def fallback_day(hours: DataFrame) -> DataFrame:
    """(owner_id, day, digest) without a model, from hour digests (owner_id, day, period_start_ms, label, digest).

    Summaries in order behind their hour, lists merged without repeats up to ten items, up to three moods.
    """
    filled = hours.filter("digest IS NOT NULL").filter(~is_empty(F.col("digest")))
    per = filled.groupBy("owner_id", "day").agg(F.sort_array(F.collect_list(F.struct("period_start_ms", "label", "digest"))).alias("h"))
    told = F.filter("h", lambda x: ~is_blank(x["digest"]["summary"]))
    summary = F.array_join(F.transform(told, lambda x: F.concat(F.substring_index(x["label"], ",", 1), F.lit(": "), x["digest"]["summary"])), " ")
    merged = lambda n: F.slice(F.array_distinct(F.flatten(F.transform("h", lambda x: x["digest"][n]))), 1, MAX_ITEMS).alias(n)
    moods = F.filter(F.transform("h", lambda x: x["digest"]["mood"]), lambda m: ~is_blank(m))
    mood = F.array_join(F.slice(F.array_distinct(moods), 1, MAX_MOODS), ", ")
    return per.select("owner_id", "day", F.struct(summary.alias("summary"), *[merged(n) for n in LISTS], mood.alias("mood")).alias("digest"))
