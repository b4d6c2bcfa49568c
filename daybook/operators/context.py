"""Prompts from hits, and what an answer cites."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.textops import spaced_words, trimmed
from daybook.functions.timeutil import day_label, hhmm
from daybook.schemas import DAY, HOUR

#: Tokens a hit costs besides its text; tokens at which no more hits are taken; those kept for the answer and as reserve.
HIT_COST, STOP_AT, ANSWER_TOKENS, RESERVE = 30, 50, 600, 64
NOTHING = "(ничего не найдено)\n"
#: What the model is told before every question, and how freely it answers.
SYSTEM = """Ты — помощник по личному дневнику пользователя. Дневник — это автоматическая расшифровка разговоров вокруг пользователя (без пунктуации, возможны ошибки распознавания, говорящие не подписаны) и сводки по часам и дням.
Отвечай по-русски, коротко и по делу, только на основе фрагментов из вопроса. После каждого факта ставь ссылку на фрагмент в квадратных скобках, например [2].
Если во фрагментах нет ответа — прямо скажи, что в дневнике этого не нашлось. Ничего не выдумывай. Не пересказывай фрагменты целиком."""
TEMPERATURE = 0.3


def source_labels(chunks: DataFrame, zone: str | Column) -> DataFrame:
    """chunks with label: day, and the span of the hour or the transcript; equal minutes once."""
    a, b = hhmm(F.col("start_ms"), zone), hhmm(F.col("end_ms"), zone)
    day = day_label(F.col("day"))
    label = (
        F.when(F.col("kind") == DAY, F.concat(day, F.lit(", итог дня")))
        .when(F.col("kind") == HOUR, F.concat(day, F.lit(", сводка "), a, F.lit("–"), b))
        .otherwise(F.concat(day, F.lit(", "), F.when(a == b, a).otherwise(F.concat(a, F.lit("–"), b)), F.lit(", расшифровка")))
    )
    return chunks.withColumn("label", label)


def word_tokens(text: Column) -> Column:
    """A stand-in for a tokenizer: words."""
    return F.size(spaced_words(text))


def build_contexts(questions: DataFrame, hits: DataFrame, budget: int, zone: str | Column, count_tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """(qid, user_prompt, sources): hits (qid, rank and chunk columns) in rank order as far as the budget goes, then by time.

    questions has qid, text, today. A hit that doesn't fit is cut if a third of it does, else left out for smaller ones. The few hits of a
    question are an array, and taking them is one fold over it.
    """
    header = F.concat(F.lit("Сегодня "), day_label(F.col("today")), F.lit(".\n\nФрагменты дневника:\n"))
    footer = F.concat(F.lit("\n\nВопрос: "), trimmed(F.col("text")))
    labelled = source_labels(hits, zone).withColumn("cost", (count_tokens(F.col("text")) + HIT_COST).cast("int"))
    per = labelled.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("chunk_id"), "day", "start_ms", "kind", "label", "text", "cost"))).alias("hits"))
    q = questions.select("qid", header.alias("header"), footer.alias("footer")).join(per, "qid", "left")
    q = q.withColumn("room", (F.lit(budget) - count_tokens(F.col("header")) - count_tokens(F.col("footer"))).cast("int"))
    # order of the picked: day, start, day digests first
    kind = "STRUCT<day: STRING, start_ms: BIGINT, late: BOOLEAN, rank: INT, chunk_id: BIGINT, label: STRING, text: STRING>"
    fold = f"""
      aggregate(coalesce(hits, array()), named_struct('room', room, 'picked', CAST(array() AS ARRAY<{kind}>)),
        (s, h) -> CASE
          WHEN s.room <= {STOP_AT} THEN s
          WHEN h.cost <= s.room THEN named_struct('room', s.room - h.cost, 'picked', array_append(s.picked, CAST(named_struct('day', h.day, 'start_ms', h.start_ms, 'late', h.kind <> '{DAY}', 'rank', h.rank, 'chunk_id', h.chunk_id, 'label', h.label, 'text', h.text) AS {kind})))
          WHEN s.room >= h.cost div 3 THEN named_struct('room', 0, 'picked', array_append(s.picked, CAST(named_struct('day', h.day, 'start_ms', h.start_ms, 'late', h.kind <> '{DAY}', 'rank', h.rank, 'chunk_id', h.chunk_id, 'label', h.label,
            'text', concat(regexp_replace(left(h.text, greatest(1, CAST(floor(char_length(h.text) * CAST(s.room - {HIT_COST} AS DOUBLE) / (h.cost - {HIT_COST})) AS INT))), '(?s) [^ ]*$', ''), ' …')) AS {kind})))
          ELSE s END)"""
    picked = F.array_sort(F.expr(fold)["picked"])
    q = q.withColumn("picked", picked)
    blocks = F.array_join(F.transform("picked", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), x["label"], F.lit(")\n"), x["text"], F.lit("\n\n"))), "")
    body = F.when(F.size("picked") == 0, NOTHING).otherwise(blocks)
    sources = F.transform("picked", lambda x, i: F.struct((i + 1).alias("n"), x["chunk_id"].alias("chunk_id"), x["label"].alias("label")))
    return q.select("qid", F.concat("header", body, "footer").alias("user_prompt"), sources.alias("sources"))


def answer_budget(context: int, system_tokens: int) -> int:
    return context - ANSWER_TOKENS - system_tokens - RESERVE


def answer_questions(contexts: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], system: str = SYSTEM, max_tokens: int = ANSWER_TOKENS, temperature: float = TEMPERATURE) -> DataFrame:
    """contexts with answer: fn takes frames of requests (system, prompt, max_tokens, temperature) and gives texts."""
    request = F.struct(F.lit(system).alias("system"), F.col("user_prompt").alias("prompt"), F.lit(max_tokens).alias("max_tokens"), F.lit(float(temperature)).alias("temperature"))
    return contexts.withColumn("answer", F.pandas_udf(fn, "string")(request))


def extract_citations(answer: Column) -> Column:
    """Distinct numbers of [1], [3, 4] or [2;5], of one or two digits."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2}(?:\s*[,;]\s*\d{1,2})*)\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*"))), lambda x: F.trim(x).cast("int")))


def cited_sources(answers: DataFrame) -> DataFrame:
    """answers (answer, sources) with cited: the sources whose number is cited, or all if none is."""
    found = F.filter("sources", lambda s: F.array_contains(extract_citations(F.col("answer")), s["n"]))
    return answers.withColumn("cited", F.when(F.size(found) == 0, F.col("sources")).otherwise(found))
