"""Diary-shaped tables derived from the generic test tables, for queries, tests and the bench. All in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.functions.textops import spaced_words
from daybook.functions.timeutil import hour_start, local_day
from daybook.functions.vectors import quantize
from daybook.schemas import HOUR_MS

#: 2024-01-01, and the moment from which plans look back.
D0, DAY_MS = 1_704_067_200_000, 86_400_000
NOW_MS = D0 + 25 * DAY_MS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as recognized segments of seven owners."""
    conv = F.col("conv_id")
    start = F.lit(D0) + conv % 30 * DAY_MS + F.floor(conv / 30) % 24 * HOUR_MS + F.col("turn") * 120_000
    df = read(spark, sf_dir, "conversations").withColumn("start_ms", start.cast("long"))
    df = df.withColumn("end_ms", F.col("start_ms") + F.least(F.size(spaced_words(F.col("text"))) * 400, F.lit(110_000)).cast("long"))
    return df.select(
        F.concat(F.lit("o"), (conv % 7).cast("string")).alias("owner_id"),
        (conv * 100 + F.col("turn")).alias("id"),
        "start_ms",
        "end_ms",
        local_day(F.col("start_ms"), "UTC").alias("day"),
        "text",
        F.lit("asr").alias("model"),
        F.lit("").alias("lang"),
        (F.col("end_ms") + 60_000).alias("created_ms"),
        "role",
    )


def long_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as very long segments, one owner per source: skewed, and many beyond a chunk."""
    doc = F.col("doc_id")
    start = F.lit(D0) + doc % 30 * DAY_MS + F.floor(doc / 30) % 24 * HOUR_MS + doc % 60 * 60_000
    df = read(spark, sf_dir, "documents").withColumn("start_ms", start.cast("long"))
    return df.select(F.concat(F.lit("s"), "source").alias("owner_id"), doc.alias("id"), "start_ms", (F.col("start_ms") + 50_000).alias("end_ms"), local_day(F.col("start_ms"), "UTC").alias("day"), "text", F.lit("asr").alias("model"), F.lit("").alias("lang"), (F.col("start_ms") + 110_000).alias("created_ms"))


def _first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(spaced_words(text), 1, n), " ")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour digests of the transcripts, some cut, stale or missing, and a day digest for two days of three."""
    t = transcripts(spark, sf_dir).withColumn("period_start_ms", hour_start(F.col("start_ms"), "UTC"))
    ordered = F.sort_array(F.collect_list(F.struct("start_ms", "id", "text", "role")))
    hours = t.groupBy("owner_id", "day", "period_start_ms").agg(ordered.alias("turns"), F.count("*").alias("n"), F.max("created_ms").alias("last"))
    digest = F.to_json(
        F.struct(
            _first_words(F.col("turns")[0]["text"], 8).alias("summary"),
            F.transform("turns", lambda x: _first_words(x["text"], 3)).alias("events"),
            F.array().cast("array<string>").alias("agreements"),
            F.transform(F.filter("turns", lambda x: x["role"] == "user"), lambda x: _first_words(x["text"], 2)).alias("tasks"),
            F.array().cast("array<string>").alias("ideas"),
            F.element_at("turns", -1)["role"].alias("mood"),
        )
    )
    k = F.floor(F.col("period_start_ms") / HOUR_MS)
    cut = F.when(k % 7 == 0, F.substring(digest, F.lit(1), F.floor(F.char_length(digest) * 0.6).cast("int"))).otherwise(digest)
    hour_rows = hours.filter(k % 13 != 0).select("owner_id", "day", "period_start_ms", F.lit("HOUR").alias("kind"), cut.alias("json"), F.lit("m").alias("model"), (F.col("n") - F.when(k % 11 == 0, 1).otherwise(0)).alias("source_count"), F.col("last").alias("source_max_created_ms"), (F.col("last") + 1000).alias("created_ms"), F.lit(10).cast("long").alias("gen_ms"))
    days = t.groupBy("owner_id", "day").agg(F.count("*").alias("n"), F.max("created_ms").alias("last")).filter(F.dayofmonth(F.to_date("day")) % 3 != 0)
    day_json = F.to_json(F.struct(F.concat(F.lit("день "), "day").alias("summary"), F.array(F.lit("итог")).alias("events"), F.array().cast("array<string>").alias("agreements"), F.array().cast("array<string>").alias("tasks"), F.array().cast("array<string>").alias("ideas"), F.lit("ровно").alias("mood")))
    day_rows = days.select("owner_id", "day", F.lit(0).cast("long").alias("period_start_ms"), F.lit("DAY").alias("kind"), day_json.alias("json"), F.lit("m").alias("model"), F.col("n").alias("source_count"), F.col("last").alias("source_max_created_ms"), (F.col("last") + 1000).alias("created_ms"), F.lit(20).cast("long").alias("gen_ms"))
    return hour_rows.unionByName(day_rows)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 ms; each event gives a stretch of them with the probability and level of its type."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (F.col("event_id") % 40 + 1).alias("n"), ms.alias("ts_ms"))
    w = Window.partitionBy("user_id").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("first_ms", F.min("ts_ms").over(w))
    f = e.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("frame_no", F.col("before") + F.col("k"))
    kind = F.col("event_type")
    low = F.col("user_id") % 10 == 0
    prob = F.when(kind == "error", F.when(low, 0.4).otherwise(0.05)).when(kind == "signup", F.when(low, 0.4).otherwise(0.2)).when(kind == "view", 0.4).when(kind == "click", 0.9).otherwise(0.95)
    return f.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner_id"),
        "frame_no",
        (F.col("first_ms") + F.col("frame_no") * 32).alias("frame_start_ms"),
        prob.alias("prob"),
        F.when(kind == "error", -96.0).otherwise(F.least(F.lit(0.0), F.col("value") / 10 - 60)).alias("dbfs"),
        (F.col("event_id") % 2 == 1).alias("screen_on"),
        ((kind == "error") & (F.col("event_id") % 5 == 0)).alias("silenced"),
        (kind == "error").alias("all_zero"),
        F.lit(512).alias("n_samples"),
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("label") * 3 + v % 3).cast("int")), "yyyy-MM-dd")
    return read(spark, sf_dir, "embeddings").select(F.lit("o0").alias("owner_id"), v.alias("id"), day.alias("day"), F.when(v % 17 == 0, "m0").otherwise("m1").alias("model"), quantize(F.col("embedding")).alias("vector"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.lit("o0").alias("owner_id"), F.col("embedding").alias("vec"))


#: Questions with a date phrase in them, and their day; asked of every owner's diary.
PHRASES = ["что было вчера", "о чем говорили в среду", "в прошлую пятницу встреча", "5 декабря", "что случилось 01.01.2025", "на прошлой неделе", "в прошлом месяце", "неделю назад", "три дня назад", "на выходных", "15 января the error", "недавно про пароли", "сегодня user"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, owner_id, text, today): fixed phrases, and every benchmark passage."""
    fixed = spark.createDataFrame([(k, t) for k, t in enumerate(PHRASES)], "qid long, text string")
    asked = read(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("qid"), "text")
    both = fixed.unionByName(asked)
    return both.select("qid", F.concat(F.lit("o"), (F.col("qid") % 7).cast("string")).alias("owner_id"), "text", F.lit("2024-01-31").cast("date").alias("today"))


def current_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ua = F.when(i % 20 == 0, 0.0).when(i % 10 == 0, F.col("value") / 1000).otherwise(F.col("value") * 1000) * F.when(i % 2 == 0, 1).otherwise(-1)
    return read(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("user_id").alias("device_id"), F.round(ua).cast("long").alias("current_ua"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per device and day that it has samples on: the whole day's middle half."""
    day = F.floor(F.col("ts_ms") / DAY_MS)
    return current_samples(spark, sf_dir).select("device_id", day.alias("d")).distinct().select("device_id", (F.col("device_id") * 100_000 + F.col("d")).alias("run_id"), (F.col("d") * DAY_MS + 21_600_000).alias("run_start_ms"), (F.col("d") * DAY_MS + 64_800_000).alias("run_end_ms"))


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("model"), F.floor("value").cast("long").alias("prompt_tokens"), (k * 10).alias("prompt_ms"), F.floor(F.col("value") / 4).cast("long").alias("gen_tokens"), (k * 7).alias("gen_ms"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(kind == "error", "E").when(kind == "purchase", "W").when(kind == "signup", "D").otherwise("I")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"), level.alias("level"), kind.alias("tag"), F.col("props").alias("message"))


# The same tables for DuckDB, as common table expressions.
TRANSCRIPTS_SQL = """t AS (
  SELECT 'o' || (conv_id % 7) AS owner_id, conv_id * 100 + turn AS id, s AS start_ms, s + least(w * 400, 110000) AS end_ms,
         strftime(make_timestamp(s * 1000), '%Y-%m-%d') AS day, text, role, s + least(w * 400, 110000) + 60000 AS created_ms,
         s // 3600000 * 3600000 AS hour_ms
  FROM (SELECT *, 1704067200000 + conv_id % 30 * 86400000 + conv_id // 30 % 24 * 3600000 + turn * 120000 AS s,
               len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM conversations))"""
LONG_SQL = """lt AS (
  SELECT 's' || source AS owner_id, doc_id AS id, s AS start_ms, s + 50000 AS end_ms, strftime(make_timestamp(s * 1000), '%Y-%m-%d') AS day,
         text, s + 110000 AS created_ms, s // 3600000 * 3600000 AS hour_ms
  FROM (SELECT *, 1704067200000 + doc_id % 30 * 86400000 + doc_id // 30 % 24 * 3600000 + doc_id % 60 * 60000 AS s FROM documents))"""
_FIRST = "array_to_string(list_slice(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''), 1, {}), ' ')"
SUMMARIES_SQL = f"""hd AS (
  SELECT owner_id, day, hour_ms, count(*) AS n, max(created_ms) AS last_ms, list(text ORDER BY start_ms, id) AS texts, list(role ORDER BY start_ms, id) AS roles,
         coalesce(list({_FIRST.format("text", 2)} ORDER BY start_ms, id) FILTER (role = 'user'), []) AS tasks
  FROM t GROUP BY owner_id, day, hour_ms),
hj AS (
  SELECT owner_id, day, hour_ms, n, last_ms, hour_ms // 3600000 AS k, {_FIRST.format("texts[1]", 8)} AS summary,
         list_transform(texts, lambda y: {_FIRST.format("y", 3)}) AS events, tasks, roles[len(roles)] AS mood FROM hd),
hjs AS (
  SELECT *, CAST(to_json({{'summary': summary, 'events': events, 'agreements': CAST([] AS VARCHAR[]), 'tasks': tasks, 'ideas': CAST([] AS VARCHAR[]), 'mood': mood}}) AS VARCHAR) AS json FROM hj),
dj AS (
  SELECT owner_id, day, count(*) AS n, max(created_ms) AS last_ms FROM t GROUP BY owner_id, day HAVING CAST(right(day, 2) AS INT) % 3 <> 0),
s AS (
  SELECT owner_id, day, hour_ms AS period_start_ms, 'HOUR' AS kind, CASE WHEN k % 7 = 0 THEN left(json, CAST(floor(length(json) * 0.6) AS BIGINT)) ELSE json END AS json,
         n - CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS source_count, last_ms AS source_max_created_ms, last_ms + 1000 AS created_ms FROM hjs WHERE k % 13 <> 0
  UNION ALL
  SELECT owner_id, day, 0, 'DAY', CAST(to_json({{'summary': 'день ' || day, 'events': ['итог'], 'agreements': CAST([] AS VARCHAR[]), 'tasks': CAST([] AS VARCHAR[]), 'ideas': CAST([] AS VARCHAR[]), 'mood': 'ровно'}}) AS VARCHAR), n, last_ms, last_ms + 1000 FROM dj)"""
FRAMES_SQL = """f AS (
  SELECT 'u' || user_id AS owner_id, before + k AS frame_no, first_ms + (before + k) * 32 AS frame_start_ms,
         CASE event_type WHEN 'error' THEN CASE WHEN user_id % 10 = 0 THEN 0.4 ELSE 0.05 END WHEN 'signup' THEN CASE WHEN user_id % 10 = 0 THEN 0.4 ELSE 0.2 END
              WHEN 'view' THEN 0.4 WHEN 'click' THEN 0.9 ELSE 0.95 END AS prob,
         CASE WHEN event_type = 'error' THEN -96.0 ELSE least(0.0, value / 10 - 60) END AS dbfs, event_id % 2 = 1 AS screen_on,
         event_type = 'error' AND event_id % 5 = 0 AS silenced, event_type = 'error' AS all_zero, 512 AS n_samples
  FROM (SELECT *, unnest(range(0, n)) AS k FROM (
    SELECT *, CAST(sum(n) OVER w AS BIGINT) - n AS before, min(epoch_us(ts) // 1000) OVER w AS first_ms FROM (SELECT *, event_id % 40 + 1 AS n FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))"""
