"""Every query of the diary library by name: a Spark job over the given tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import models, timeutil, vectors
from daybook.operators import buffer, chunks, context, dates, digests, logs, search, segmentation, summaries, telemetry, timeline, transcription
from daybook.plans import diary_path, index, summarize
from daybook.sources import chunk_store, day_counts, diary, fixtures, loglines, segments
from daybook.sources.fixtures import D0, DAY_MS, FRAMES_SQL, LONG_SQL, NOW_MS, SUMMARIES_SQL, TRANSCRIPTS_SQL
from daybook.sources.shared import cut, shared_path
from daybook.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
ZONE, MSK = "UTC", "Europe/Moscow"
CUT_DAY = "2024-01-11"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


T, S = TRANSCRIPTS_SQL, f"{TRANSCRIPTS_SQL},\n{SUMMARIES_SQL}"
_J = "array_to_string({}, '|')"
#: The digests of SUMMARIES_SQL that can be read: none of its texts needs trimming.
_D = f"""{S},
d AS (SELECT *, json_extract_string(json, '$.summary') AS summary, json_extract_string(json, '$.mood') AS mood,
        list_distinct_first(CAST(json_extract(json, '$.events') AS VARCHAR[])) AS events, list_distinct_first(CAST(json_extract(json, '$.tasks') AS VARCHAR[])) AS tasks
      FROM s WHERE json_valid(json))""".replace("list_distinct_first(CAST(json_extract(json, '$.events') AS VARCHAR[]))", "list_filter(CAST(json_extract(json, '$.events') AS VARCHAR[]), lambda x, i: x <> '' AND list_position(CAST(json_extract(json, '$.events') AS VARCHAR[]), x) = i)").replace("list_distinct_first(CAST(json_extract(json, '$.tasks') AS VARCHAR[]))", "list_filter(CAST(json_extract(json, '$.tasks') AS VARCHAR[]), lambda x, i: x <> '' AND list_position(CAST(json_extract(json, '$.tasks') AS VARCHAR[]), x) = i)")


# ---- days


@query(f"WITH {T} SELECT owner_id, day, count(*) AS segments, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM t GROUP BY owner_id, day")
def day_overview(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.day_overview(fixtures.transcripts(spark, sf))


@query(f"WITH {T} SELECT owner_id, id, start_ms, day, text FROM t WHERE day IN ('2024-01-05', '2024-01-06')")
def day_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.day_transcripts(fixtures.transcripts(spark, sf), ["2024-01-05", "2024-01-06"]).select("owner_id", "id", "start_ms", "day", "text")


@query(f"WITH {_D} SELECT o.owner_id, o.day, o.n AS segments, d.summary AS summary, d.mood AS mood FROM (SELECT owner_id, day, count(*) AS n FROM t GROUP BY owner_id, day) o LEFT JOIN (SELECT * FROM d WHERE kind = 'DAY') d ON o.owner_id = d.owner_id AND o.day = d.day")
def day_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.timeline(fixtures.transcripts(spark, sf), fixtures.summaries(spark, sf)).select("owner_id", "day", "segments", F.col("digest.summary").alias("summary"), F.col("digest.mood").alias("mood"))


@query(f"""WITH {_D}, l AS (SELECT owner_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') AS day, hour_ms, string_agg('[' || strftime(make_timestamp((start_ms + 10800000) * 1000), '%H:%M') || '] ' || text, '|' ORDER BY start_ms, id) AS lines, count(*) AS n_lines FROM t GROUP BY ALL)
SELECT l.owner_id, l.day, l.hour_ms AS period_start_ms, l.lines AS lines, l.n_lines AS n_lines, d.summary AS summary FROM l LEFT JOIN (SELECT * FROM d WHERE kind = 'HOUR') d ON l.owner_id = d.owner_id AND l.day = d.day AND l.hour_ms = d.period_start_ms""")
def day_detail(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.day_detail(fixtures.transcripts(spark, sf), fixtures.summaries(spark, sf), MSK).select("owner_id", "day", "period_start_ms", joined("lines").alias("lines"), "n_lines", F.col("digest.summary").alias("summary"))


@query(f"WITH {T} SELECT owner_id, count(*) FILTER (day >= '{CUT_DAY}') AS kept, count(*) FILTER (day < '{CUT_DAY}') AS purged FROM t GROUP BY owner_id")
def purge_before(spark: SparkSession, sf: str) -> DataFrame:
    kept, purged = timeline.purge_before(fixtures.transcripts(spark, sf), CUT_DAY)
    both = kept.groupBy("owner_id").agg(F.count("*").alias("kept")).join(purged, "owner_id", "full_outer")
    return both.select("owner_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("purged", F.lit(0)).alias("purged"))


@query("SELECT count(*) AS transcripts FROM conversations")
def transcript_count(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.transcript_count(fixtures.transcripts(spark, sf))


@query(f"WITH {S} SELECT owner_id, day, count(*) AS count, max(created_ms) AS max_created_ms FROM s GROUP BY owner_id, day")
def day_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.day_stats(fixtures.summaries(spark, sf))


@query("SELECT event_id AS event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ' ч ' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ' мин' WHEN s >= 60 THEN (s // 60) || ' мин ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' с' ELSE s || ' с' END AS spoken FROM (SELECT event_id, epoch_us(ts) // 1000 % 20000000 // 1000 AS s FROM events)")
def format_duration(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.read(spark, sf, "events").select("event_id", timeutil.format_duration(F.unix_millis(F.col("ts").cast("timestamp")) % 20_000_000).alias("spoken"))


# ---- digests


@query(f"WITH {_D} SELECT owner_id, day, period_start_ms, summary, {_J.format('events')} AS events, {_J.format('tasks')} AS tasks, mood FROM d")
def parse_digests(spark: SparkSession, sf: str) -> DataFrame:
    d = digests.parse_digests(fixtures.summaries(spark, sf)).filter(~F.col("parse_error"))
    return d.select("owner_id", "day", "period_start_ms", F.col("digest.summary").alias("summary"), joined("digest.events").alias("events"), joined("digest.tasks").alias("tasks"), F.col("digest.mood").alias("mood"))


@query()
def repair_digests(spark: SparkSession, sf: str) -> DataFrame:
    d = digests.repair_digests(digests.parse_digests(fixtures.summaries(spark, sf)))
    return d.select("owner_id", "day", "period_start_ms", "parse_error", F.col("digest.summary").alias("summary"), joined("digest.events").alias("events"), joined("digest.tasks").alias("tasks"), F.col("digest.mood").alias("mood"))


@query(f"""WITH {_D} SELECT owner_id, day, period_start_ms, CAST(to_json({{'summary': summary, 'events': events, 'agreements': CAST([] AS VARCHAR[]), 'tasks': tasks, 'ideas': CAST([] AS VARCHAR[]), 'mood': mood}}) AS VARCHAR) AS round FROM d""")
def digest_to_json(spark: SparkSession, sf: str) -> DataFrame:
    d = digests.parse_digests(fixtures.summaries(spark, sf)).filter("digest IS NOT NULL")
    return d.select("owner_id", "day", "period_start_ms", digests.digest_to_json(F.col("digest")).alias("round"))


_RENDER = "'{0}: ' || CASE WHEN trim(summary) = '' THEN '—' ELSE summary END || CASE WHEN len(events) > 0 THEN chr(10) || 'События: ' || array_to_string(events, '; ') ELSE '' END || CASE WHEN len(tasks) > 0 THEN chr(10) || 'Задачи: ' || array_to_string(tasks, '; ') ELSE '' END || CASE WHEN trim(mood) <> '' THEN chr(10) || 'Настроение: ' || mood ELSE '' END"


@query(f"WITH {_D} SELECT owner_id, day, period_start_ms, {_RENDER.format('Итог')} AS rendered FROM d")
def render_digests(spark: SparkSession, sf: str) -> DataFrame:
    d = digests.parse_digests(fixtures.summaries(spark, sf)).filter("digest IS NOT NULL")
    return d.select("owner_id", "day", "period_start_ms", digests.render_digests(F.col("digest"), F.lit("Итог")).alias("rendered"))


@query(f"WITH {_D}, i AS (SELECT owner_id, day, period_start_ms, 'events' AS kind, unnest(events) AS item, unnest(range(0, len(events))) AS pos FROM d UNION ALL SELECT owner_id, day, period_start_ms, 'tasks', unnest(tasks), unnest(range(0, len(tasks))) FROM d) SELECT owner_id, day, period_start_ms, kind, CAST(pos AS INT) AS pos, item FROM i")
def digest_items(spark: SparkSession, sf: str) -> DataFrame:
    return digests.digest_items(digests.parse_digests(fixtures.summaries(spark, sf)), "owner_id", "day", "period_start_ms")


# ---- planning


_PLAN = f"""{S}, h AS (SELECT owner_id, day, hour_ms, count(*) AS n, max(created_ms) AS m FROM t GROUP BY ALL), a AS (
  SELECT owner_id, day, 'HOUR' AS level, hour_ms AS period_start_ms, n, m, hour_ms + 3600000 <= {NOW_MS} AS over FROM h
  UNION ALL SELECT owner_id, day, 'DAY', 0, CAST(sum(n) AS BIGINT), max(m), epoch_ms(CAST(day AS DATE) + INTERVAL 1 DAY) <= {NOW_MS} FROM h GROUP BY owner_id, day), b AS (
  SELECT a.*, coalesce(s.source_count = a.n AND s.source_max_created_ms = a.m, false) AS fresh FROM a LEFT JOIN s ON a.owner_id = s.owner_id AND a.day = s.day AND a.period_start_ms = s.period_start_ms),
plan AS (SELECT *, over AND NOT fresh AND (level = 'HOUR' OR NOT bool_or(level = 'HOUR' AND NOT over) OVER w) AND NOT bool_or(level = 'DAY' AND fresh) OVER w AS todo FROM b WINDOW w AS (PARTITION BY owner_id, day))"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.plan_summaries(fixtures.transcripts(spark, sf), fixtures.summaries(spark, sf), NOW_MS, False, ZONE)


@query(f"WITH {_PLAN} SELECT owner_id, day, level, period_start_ms, n AS count, m AS max_created_ms, todo FROM plan")
def plan_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


@query(f"WITH {_PLAN} SELECT owner_id, day, kind, period_start_ms FROM s WHERE NOT (kind = 'HOUR' AND period_start_ms // 3600000 % 5 = 0 AND EXISTS (SELECT 1 FROM plan p WHERE p.owner_id = s.owner_id AND p.day = s.day))")
def drop_stale_hours(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf).filter("level = 'DAY' OR floor(period_start_ms / 3600000) % 5 <> 0")
    return summaries.drop_stale_hours(fixtures.summaries(spark, sf), plan).select("owner_id", "day", "kind", "period_start_ms")


@query(f"WITH {S} SELECT owner_id, day, period_start_ms, CASE WHEN source_count % 2 = 0 THEN 'new' ELSE 'm' END AS model FROM s")
def upsert_summaries(spark: SparkSession, sf: str) -> DataFrame:
    old = fixtures.summaries(spark, sf)
    return summaries.upsert_summaries(old, old.filter("source_count % 2 = 0").withColumn("model", F.lit("new"))).select("owner_id", "day", "period_start_ms", "model")


@query(f"WITH {_PLAN} SELECT t.owner_id, t.day, t.hour_ms AS period_start_ms, t.start_ms AS start_ms, t.id AS id, '[' || strftime(make_timestamp(t.start_ms * 1000), '%H:%M') || '] ' || t.text AS line FROM t JOIN plan p ON t.owner_id = p.owner_id AND t.day = p.day AND t.hour_ms = p.period_start_ms WHERE p.level = 'HOUR' AND p.todo")
def hour_lines(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.hour_lines(fixtures.transcripts(spark, sf), _plan(spark, sf), ZONE)


_HOUR_LINES = f"{_PLAN}, hl AS (SELECT t.owner_id, t.day, t.hour_ms, '[' || strftime(make_timestamp(t.start_ms * 1000), '%H:%M') || '] ' || t.text AS line, row_number() OVER (PARTITION BY t.owner_id, t.hour_ms ORDER BY t.start_ms, t.id) AS i FROM t JOIN plan p ON t.owner_id = p.owner_id AND t.day = p.day AND t.hour_ms = p.period_start_ms WHERE p.level = 'HOUR' AND p.todo)"


def _packs(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["owner_id", "day", "period_start_ms"]
    return summaries.pack_lines(hour_lines(spark, sf), keys, ["start_ms", "id"], "line", 400)


@query(f"""WITH RECURSIVE {_HOUR_LINES}, hc AS MATERIALIZED (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) + 1 AS cost FROM hl),
pk AS (SELECT owner_id, day, hour_ms, line, i, cost AS used, CAST(0 AS BIGINT) AS pack_no, CAST(0 AS BIGINT) AS line_no FROM hc WHERE i = 1
  UNION ALL SELECT hc.owner_id, hc.day, hc.hour_ms, hc.line, hc.i, CASE WHEN pk.used + hc.cost > 400 THEN hc.cost ELSE pk.used + hc.cost END, pk.pack_no + CASE WHEN pk.used + hc.cost > 400 THEN 1 ELSE 0 END, CASE WHEN pk.used + hc.cost > 400 THEN 0 ELSE pk.line_no + 1 END
  FROM pk JOIN hc ON hc.owner_id = pk.owner_id AND hc.hour_ms = pk.hour_ms AND hc.i = pk.i + 1)
SELECT owner_id, day, hour_ms AS period_start_ms, pack_no, line_no, line AS text FROM pk""")
def pack_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _packs(spark, sf)


_PACKS = f"""RECURSIVE {_HOUR_LINES}, hc AS MATERIALIZED (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) + 1 AS cost FROM hl),
pk AS (SELECT owner_id, day, hour_ms, line, i, cost AS used, CAST(0 AS BIGINT) AS pack_no FROM hc WHERE i = 1
  UNION ALL SELECT hc.owner_id, hc.day, hc.hour_ms, hc.line, hc.i, CASE WHEN pk.used + hc.cost > 400 THEN hc.cost ELSE pk.used + hc.cost END, pk.pack_no + CASE WHEN pk.used + hc.cost > 400 THEN 1 ELSE 0 END
  FROM pk JOIN hc ON hc.owner_id = pk.owner_id AND hc.hour_ms = pk.hour_ms AND hc.i = pk.i + 1),
pp AS (SELECT owner_id, day, hour_ms AS period_start_ms, pack_no, string_agg(line, chr(10) ORDER BY i) AS lines, count(*) OVER (PARTITION BY owner_id, hour_ms) AS n_packs FROM pk GROUP BY owner_id, day, hour_ms, pack_no),
mp AS (SELECT owner_id, day, period_start_ms, pack_no, n_packs, 'Период: ' || day || CASE WHEN n_packs > 1 THEN ', часть ' || (pack_no + 1) || ' из ' || n_packs ELSE '' END || '.' || chr(10) || '{summaries.MAP_HEAD}' || chr(10) || lines || chr(10) || chr(10) || '{summaries.FIELDS}' AS prompt FROM pp)"""


@query(f"WITH {_PACKS} SELECT * FROM mp")
def map_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.map_prompts(_packs(spark, sf), ["owner_id", "day", "period_start_ms"], F.col("day"))


_SPACED = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
#: What models.first_words_llm makes of a prompt.
_SAID = f"""'Вот ответ: {{"summary": ' || CAST(to_json(array_to_string(list_slice({_SPACED.format("prompt")}, 1, 6), ' ')) AS VARCHAR) || ', "events": [' || CAST(to_json(left(list_extract(string_split(prompt, chr(10)), -1), 20)) AS VARCHAR)
  || '], "agreements": [], "tasks": ["слов ' || len({_SPACED.format("prompt")}) || '"], "ideas": [], "mood": "{len(summaries.SYSTEM)} {summaries.HOUR_TOKENS} 0.0"}} конец'"""


@query(f"WITH {_PACKS} SELECT *, {_SAID} AS raw FROM mp")
def complete(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.complete(map_prompts(spark, sf), models.first_words_llm)


@query()
def reduce_digests(spark: SparkSession, sf: str) -> DataFrame:
    d = digests.parse_digests(fixtures.summaries(spark, sf).filter("kind = 'HOUR'")).filter("digest IS NOT NULL")
    items = d.select("owner_id", F.col("period_start_ms").alias("n"), F.col("owner_id").alias("label"), digests.digest_to_json(F.col("digest")).alias("text"))
    made = summarize.reduce_digests(items, ["owner_id"], models.first_words_llm, 400, False)
    return made.select("owner_id", F.col("digest.summary").alias("summary"), joined("digest.tasks").alias("tasks"))


@query()
def summarize_days(spark: SparkSession, sf: str) -> DataFrame:
    d = digests.repair_digests(digests.parse_digests(fixtures.summaries(spark, sf).filter("kind = 'HOUR'"))).select("owner_id", "day", "period_start_ms", "digest").filter("digest IS NOT NULL")
    made = summarize.summarize_days(d, models.first_words_llm, 800, ZONE)
    return made.select("owner_id", "day", F.col("digest.summary").alias("summary"), joined("digest.events").alias("events"))


@query(f"""WITH {_D}, h AS (SELECT *, strftime(make_timestamp(period_start_ms * 1000), '%H:%M') AS label FROM d WHERE kind = 'HOUR' AND (summary <> '' OR len(events) + len(tasks) > 0)),
g AS (SELECT owner_id, day, string_agg(label || ': ' || summary, ' ' ORDER BY period_start_ms) FILTER (summary <> '') AS summary, flatten(list(events ORDER BY period_start_ms)) AS e, flatten(list(tasks ORDER BY period_start_ms)) AS k, list(mood ORDER BY period_start_ms) FILTER (mood <> '') AS m FROM h GROUP BY owner_id, day)
SELECT owner_id, day, coalesce(summary, '') AS summary, {_J.format("list_filter(e, lambda x, i: list_position(e, x) = i)[1:10]")} AS events, {_J.format("list_filter(k, lambda x, i: list_position(k, x) = i)[1:10]")} AS tasks, coalesce(array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i)[1:3], ', '), '') AS mood FROM g""")
def fallback_day(spark: SparkSession, sf: str) -> DataFrame:
    d = digests.parse_digests(fixtures.summaries(spark, sf).filter("kind = 'HOUR'")).withColumn("label", timeutil.hhmm(F.col("period_start_ms"), ZONE))
    made = summaries.fallback_day(d)
    return made.select("owner_id", "day", F.col("digest.summary").alias("summary"), joined("digest.events").alias("events"), joined("digest.tasks").alias("tasks"), F.col("digest.mood").alias("mood"))


# ---- the chunk index


@query(f"""WITH RECURSIVE {T}, {LONG_SQL}, al AS (SELECT owner_id, day, hour_ms, id, start_ms, end_ms, text FROM t UNION ALL SELECT owner_id, day, hour_ms, id, start_ms, end_ms, text FROM lt),
pw AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM al),
pp AS (SELECT *, unnest(range(0, len(ws), 280)) AS a FROM pw WHERE len(ws) > 0),
pc AS MATERIALIZED (SELECT owner_id, day, hour_ms, start_ms, end_ms, least(280, len(ws) - a) AS n, '[' || strftime(make_timestamp(start_ms * 1000), '%H:%M') || '] ' || array_to_string(list_slice(ws, a + 1, a + 280), ' ') AS line, row_number() OVER (PARTITION BY owner_id, hour_ms ORDER BY start_ms, id, a) AS i FROM pp),
ck AS (SELECT owner_id, day, hour_ms, start_ms, end_ms, line, i, n AS used, CAST(0 AS BIGINT) AS k FROM pc WHERE i = 1
  UNION ALL SELECT pc.owner_id, pc.day, pc.hour_ms, pc.start_ms, pc.end_ms, pc.line, pc.i, CASE WHEN ck.used >= 180 OR ck.used + pc.n > 280 THEN pc.n ELSE ck.used + pc.n END, ck.k + CASE WHEN ck.used >= 180 OR ck.used + pc.n > 280 THEN 1 ELSE 0 END
  FROM ck JOIN pc ON pc.owner_id = ck.owner_id AND pc.hour_ms = ck.hour_ms AND pc.i = ck.i + 1)
SELECT owner_id, day, 'TRANSCRIPT' AS kind, first(start_ms ORDER BY i) AS start_ms, last(end_ms ORDER BY i) AS end_ms, string_agg(line, chr(10) ORDER BY i) AS text, k AS ord FROM ck GROUP BY owner_id, day, hour_ms, k""")
def chunk_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_transcripts(fixtures.transcripts(spark, sf).unionByName(fixtures.long_transcripts(spark, sf), allowMissingColumns=True), ZONE)


_RENDERED = f"""{_D}, cd AS (SELECT owner_id, day, kind, CASE WHEN kind = 'DAY' THEN epoch_ms(CAST(day AS DATE)) ELSE period_start_ms END AS start_ms,
  CASE WHEN kind = 'DAY' THEN epoch_ms(CAST(day AS DATE) + INTERVAL 1 DAY) ELSE period_start_ms + 3600000 END AS end_ms,
  replace({_RENDER.format('@')}, '@: ', CASE WHEN kind = 'DAY' THEN 'Итог дня: ' ELSE 'Сводка за ' || strftime(make_timestamp(period_start_ms * 1000), '%H:%M') || '–' || strftime(make_timestamp((period_start_ms + 3600000) * 1000), '%H:%M') || ': ' END) AS text
  FROM d WHERE summary <> '' OR len(events) + len(tasks) > 0)"""


@query(f"WITH {_RENDERED} SELECT owner_id, day, kind, start_ms, CAST(end_ms AS BIGINT) AS end_ms, text FROM cd")
def chunk_digests(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_digests(fixtures.summaries(spark, sf), ZONE).drop("ord")


def turn_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a chunk of its own, and the digests: chunks that SQL can make too."""
    t = fixtures.transcripts(spark, sf).select("owner_id", "day", F.lit("TRANSCRIPT").alias("kind"), "start_ms", "end_ms", "text", F.col("id").alias("ord"))
    return chunks.hash_chunks(t.unionByName(chunks.chunk_digests(fixtures.summaries(spark, sf), ZONE)))


_CHUNKS = f"""{_RENDERED}, ca AS (SELECT owner_id, day, 'TRANSCRIPT' AS kind, start_ms, end_ms, text, id AS ord FROM t UNION ALL SELECT owner_id, day, kind, start_ms, end_ms, text, 1000000000000 + CASE kind WHEN 'DAY' THEN 1 ELSE 0 END FROM cd),
c AS (SELECT owner_id, day, kind, start_ms, end_ms, text, sha1(kind || chr(10) || text) AS hash FROM ca QUALIFY row_number() OVER (PARTITION BY owner_id, day, sha1(kind || chr(10) || text) ORDER BY ord, start_ms) = 1)"""


@query(f"WITH {_CHUNKS} SELECT owner_id, day, kind, start_ms, text, hash FROM c")
def hash_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return turn_chunks(spark, sf).select("owner_id", "day", "kind", "start_ms", "text", "hash")


def _index_days(spark: SparkSession, sf: str) -> DataFrame:
    """What was indexed before: all days but every fifth, with a wrong signature on every fourth."""
    all_days = chunks.changed_days(fixtures.transcripts(spark, sf), fixtures.summaries(spark, sf), spark.createDataFrame([], "owner_id string, day string, signature string"))
    d = F.dayofmonth(F.to_date("day"))
    return all_days.filter(d % 5 != 0).select("owner_id", "day", F.when(d % 4 == 0, "old").otherwise(F.col("signature")).alias("signature"))


@query(f"""WITH {S}, td AS (SELECT owner_id, day, count(*) AS n, max(created_ms) AS m FROM t GROUP BY ALL), sd AS (SELECT owner_id, day, count(*) AS n, max(created_ms) AS m FROM s GROUP BY ALL)
SELECT coalesce(td.owner_id, sd.owner_id) AS owner_id, coalesce(td.day, sd.day) AS day, 't' || coalesce(td.n, 0) || ':' || coalesce(td.m, 0) || '|s' || coalesce(sd.n, 0) || ':' || coalesce(sd.m, 0) AS signature
FROM td FULL OUTER JOIN sd ON td.owner_id = sd.owner_id AND td.day = sd.day WHERE CAST(right(coalesce(td.day, sd.day), 2) AS INT) % 5 = 0 OR CAST(right(coalesce(td.day, sd.day), 2) AS INT) % 4 = 0""")
def changed_days(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.changed_days(fixtures.transcripts(spark, sf), fixtures.summaries(spark, sf), _index_days(spark, sf))


@query(SQL["changed_days"])
def days_to_index(spark: SparkSession, sf: str) -> DataFrame:
    """Both sources grow by streams of several batches, which keep the counts; the changed days are found from those."""
    counts = shared_path(spark, "counts")
    for source, rows in (("transcripts", fixtures.transcripts(spark, sf).drop("role")), ("summaries", fixtures.summaries(spark, sf))):
        told, table, log = (shared_path(spark, f"{source}-{x}") for x in ("in", "table", "log"))
        rows.repartition(4).write.parquet(told)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(told)
        jobs.counted_stream(stream, table, counts, source, log).awaitTermination()
    return day_counts.days_to_index(spark, counts, _index_days(spark, sf))


@query(f"""WITH {_CHUNKS}, dn AS (SELECT owner_id, day, CAST(right(day, 2) AS INT) AS d, hash, kind FROM c)
SELECT owner_id, day, count(*) FILTER (kind = 'HOUR') AS added, count(*) FILTER (kind = 'TRANSCRIPT') AS removed FROM dn WHERE (d % 5 = 0 OR d % 4 = 0) AND kind <> 'DAY' GROUP BY owner_id, day""")
def sync_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Before: the chunks without hours. After: the changed days have hours, and no transcripts any more."""
    every = turn_chunks(spark, sf)
    old = every.filter("kind <> 'HOUR'").select("*", F.lit(None).cast("struct<scale: float, q: array<tinyint>>").alias("vector"), F.lit("").alias("model"))
    drafts = every.filter("kind <> 'TRANSCRIPT'")
    _, report = chunks.sync_chunks(old, drafts, changed_days(spark, sf), fixtures.transcripts(spark, sf))
    return report


@query(f"""WITH {_CHUNKS}, dn AS (SELECT owner_id, day, CAST(right(day, 2) AS INT) AS d, hash, kind FROM c)
SELECT owner_id, day, kind, hash FROM dn WHERE CASE WHEN d % 5 = 0 OR d % 4 = 0 THEN kind <> 'TRANSCRIPT' ELSE kind <> 'HOUR' END""")
def sync_index(spark: SparkSession, sf: str) -> DataFrame:
    """The table after a sync, read from disk. Before: the chunks without hours. After: the changed days have hours, and no transcripts any more."""
    every = cut(turn_chunks(spark, sf))
    old = every.filter("kind <> 'HOUR'").select("*", F.lit(None).cast("struct<scale: float, q: array<tinyint>>").alias("vector"), F.lit("").alias("model"))
    store = chunk_store.ChunkStore(spark, shared_path(spark, "index"))
    marked = _index_days(spark, sf).select("owner_id", "day", "signature", F.lit(0).cast("long").alias("indexed_ms"), F.lit(0).cast("long").alias("chunks"))
    store.commit(old, marked, [r.day for r in every.select("day").distinct().collect()])
    changed = chunks.changed_days(fixtures.transcripts(spark, sf), fixtures.summaries(spark, sf), store.index_days())
    index.sync_index(store, every.filter("kind <> 'TRANSCRIPT'"), changed, fixtures.transcripts(spark, sf), NOW_MS)
    return store.chunks().select("owner_id", "day", "kind", "hash")


@query("SELECT vec_id AS id, strftime(DATE '2024-01-01' + CAST(label * 3 + vec_id % 3 AS INT), '%Y-%m-%d') AS day FROM embeddings WHERE vec_id % 17 = 0")
def pending_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.chunk_vectors(spark, sf).withColumn("start_ms", F.lit(0))
    return chunks.pending_embeddings(rows, "m1").select("id", "day")


@query("SELECT doc_id AS doc_id, regexp_replace('[10:00] ' || replace(text, chr(10), chr(10) || '[09:30] '), '(^|\\n)\\[\\d{2}:\\d{2}\\] ', '\\1', 'g') AS text FROM documents")
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    stamped = F.concat(F.lit("[10:00] "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n[09:30] ")))
    return fixtures.read(spark, sf, "documents").select("doc_id", chunks.embedding_text(stamped).alias("text"))


@query(f"""WITH {_CHUNKS}, e AS (SELECT owner_id, day, hash, list_transform(range(0, 16), lambda i: len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND length(w) % 16 = i))) AS v FROM c),
u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM e), w AS (SELECT *, list_transform(v, lambda x: CAST(x / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT)) AS f FROM u),
z AS (SELECT *, CAST(CASE WHEN list_max(f) = 0 THEN 1 ELSE CAST(list_max(f) AS DOUBLE) / 127 END AS FLOAT) AS scale FROM w)
SELECT owner_id, day, hash, 'lengths16' AS model, round(CAST(scale AS DOUBLE), 6) AS scale, array_to_string(list_transform(f, lambda x: greatest(-127, least(127, CAST(floor(CAST(x AS DOUBLE) / CAST(scale AS DOUBLE) + 0.5) AS INT)))), '|') AS q FROM z""")
def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = turn_chunks(spark, sf).select("*", F.lit(None).cast("struct<scale: float, q: array<tinyint>>").alias("vector"), F.lit("").alias("model"))
    done = chunks.embed_chunks(rows, models.length_embedder, "lengths16")
    return done.select("owner_id", "day", "hash", "model", F.round(F.col("vector.scale").cast("double"), 6).alias("scale"), joined(F.transform("vector.q", lambda x: x.cast("string"))).alias("q"))


@query("SELECT vec_id AS vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3)) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x * 9))), 4) AS total FROM embeddings")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors.l2_normalize(F.transform("embedding", lambda x: x * 3))
    return fixtures.read(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_QUANT = """q AS (SELECT vec_id, label, CAST(CASE WHEN m = 0 THEN 1 ELSE m / 127 END AS FLOAT) AS scale, embedding FROM (SELECT *, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS m FROM embeddings)),
qq AS (SELECT vec_id, label, scale, list_transform(embedding, lambda x: greatest(-127, least(127, CAST(floor(CAST(x / scale AS DOUBLE) + 0.5) AS INT)))) AS q FROM q)"""


@query(f"WITH {_QUANT} SELECT vec_id, round(CAST(scale AS DOUBLE), 6) AS scale, array_to_string(q, '|') AS q FROM qq")
def quantize(spark: SparkSession, sf: str) -> DataFrame:
    packed = fixtures.read(spark, sf, "embeddings").select("vec_id", vectors.quantize(F.col("embedding")).alias("p"))
    return packed.select("vec_id", F.round(F.col("p.scale").cast("double"), 6).alias("scale"), joined(F.transform("p.q", lambda x: x.cast("string"))).alias("q"))


@query(f"WITH {_QUANT} SELECT vec_id, array_to_string(list_transform(q, lambda x: CAST(round(CAST(CAST(x * scale AS FLOAT) AS DOUBLE) * 100000) AS BIGINT)), '|') AS v FROM qq")
def dequantize(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.read(spark, sf, "embeddings").select("vec_id", vectors.dequantize(vectors.quantize(F.col("embedding"))).alias("v"))
    return rows.select("vec_id", joined(F.transform("v", lambda x: F.round(x.cast("double") * 100_000).cast("long").cast("string"))).alias("v"))


@query("SELECT count(*) AS chunks, count(*) AS embedded, count(DISTINCT label * 3 + vec_id % 3) AS days FROM embeddings")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.index_stats(fixtures.chunk_vectors(spark, sf))


_POSTINGS = f"{_CHUNKS}, p AS (SELECT DISTINCT owner_id, hash, kind, day, start_ms, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{{L}}\\d]+')) AS word FROM c)"


@query(f"WITH {_POSTINGS} SELECT owner_id, word, count(*) AS n_chunks, min(start_ms) AS first_ms FROM p GROUP BY owner_id, word")
def build_postings(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.build_postings(turn_chunks(spark, sf)).groupBy("owner_id", "word").agg(F.count("*").alias("n_chunks"), F.min("start_ms").alias("first_ms"))


# ---- retrieval


@query()
def resolve_date_hints(spark: SparkSession, sf: str) -> DataFrame:
    q = dates.resolve_date_hints(fixtures.questions(spark, sf))
    return q.select("qid", F.date_format("from_day", "yyyy-MM-dd").alias("from_day"), F.date_format("to_day", "yyyy-MM-dd").alias("to_day"), joined("date_words").alias("date_words"))


_STOP = ", ".join(f"'{w}'" for w in "a the of to in on and or is was an what when who did i my".split())
_Q = f"""w AS (SELECT item_id + 1000 AS qid, 'o' || ((item_id + 1000) % 7) AS owner_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (
  SELECT item_id, regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{{L}}\\d]+') AS ws FROM benchmark)),
st AS (SELECT qid, owner_id, min(i) AS i, CASE WHEN regexp_matches(w, '\\d') THEN w WHEN length(w) >= 6 THEN left(w, -2) WHEN length(w) >= 4 THEN left(w, -1) ELSE w END AS stem
       FROM w WHERE w NOT IN ({_STOP}) AND (length(w) >= 3 OR regexp_matches(w, '\\d')) GROUP BY ALL)"""


@query(f"WITH {_Q} SELECT qid, string_agg(stem, '|' ORDER BY i) AS stems FROM (SELECT qid, stem, min(i) AS i FROM st GROUP BY qid, stem) GROUP BY qid")
def question_stems(spark: SparkSession, sf: str) -> DataFrame:
    q = search.question_stems(fixtures.questions(spark, sf).filter("qid >= 1000"))
    return q.filter(F.size("stems") > 0).select("qid", joined("stems").alias("stems"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks, with the turn's id."""
    return fixtures.transcripts(spark, sf).select("owner_id", "id", "day", F.lit("TRANSCRIPT").alias("kind"), "start_ms", "end_ms", "text", F.sha1(F.col("text").cast("binary")).alias("hash"))


_K = f"""{T}, {_Q}, tw AS (SELECT DISTINCT owner_id, id, start_ms, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\\p{{L}}\\d]+')) AS word FROM t),
k AS (SELECT qid, id, start_ms, count(DISTINCT stem) AS matched FROM (SELECT DISTINCT qid, owner_id, stem FROM st) q JOIN tw USING (owner_id) WHERE starts_with(word, stem) GROUP BY ALL),
k2 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY start_ms DESC, id) <= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matched DESC, start_ms DESC, id) AS rank FROM k2)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    q = search.question_stems(fixtures.questions(spark, sf).filter("qid >= 1000"))
    return search.keyword_search(q, chunks.build_postings(_turns(spark, sf)))


@query(f"WITH {_K} SELECT qid, id AS chunk_id, start_ms, matched FROM k2")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)


@query(f"WITH {_K} SELECT qid, id AS chunk_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 30")
def rank_by_stems(spark: SparkSession, sf: str) -> DataFrame:
    return search.rank_by_stems(_hits(spark, sf))


_V = f"""{_QUANT}, v AS (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(a.embedding, b.q), lambda x: CAST(x[1] AS DOUBLE) * x[2])) * CAST(b.scale AS DOUBLE), 6) AS score
  FROM embeddings a, qq b WHERE a.vec_id % 50 = 0 AND b.vec_id % 17 <> 0), vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM v QUALIFY rank <= 30)"""


@query(f"WITH {_V} SELECT qid, chunk_id, score, CAST(rank AS INT) AS rank FROM vr")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_search(fixtures.question_vectors(spark, sf), fixtures.chunk_vectors(spark, sf), "m1")


@query("""WITH l AS (SELECT user_id AS qid, event_id % 3 AS list_no, event_id AS pos, CAST(floor(value) AS BIGINT) % 50 AS id FROM events),
f AS (SELECT qid, list_no, id, min(pos) AS pos FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid, list_no ORDER BY pos, id) AS r FROM f),
s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(struct_pack(list_no := list_no, r := r)) AS seen FROM r GROUP BY qid, id)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS INT) AS rank FROM s""")
def fuse_rrf(spark: SparkSession, sf: str) -> DataFrame:
    lists = fixtures.read(spark, sf, "events").select(F.col("user_id").alias("qid"), (F.col("event_id") % 3).alias("list_no"), F.col("event_id").alias("pos"), (F.floor("value").cast("long") % 50).alias("id"))
    return search.fuse_rrf(lists)


@query(f"WITH {_K} SELECT qid, CAST(rank AS INT) AS rank, id AS chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, true AS via_text, false AS via_vector FROM r WHERE rank <= 12")
def hybrid_search_text(spark: SparkSession, sf: str) -> DataFrame:
    q = search.question_stems(fixtures.questions(spark, sf).filter("qid >= 1000"))
    t = _turns(spark, sf)
    return search.hybrid_search(q, t, chunks.build_postings(t))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """All questions with date ranges, stems, and vectors of their words."""
    q = search.question_stems(dates.resolve_date_hints(fixtures.questions(spark, sf)))
    q = cut(q)
    return q.withColumn("vec", F.pandas_udf(models.hash_embedder, "array<float>")("text")).withColumn("vec", vectors.l2_normalize(F.col("vec")))


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    rows = turn_chunks(spark, sf).select("*", F.lit(None).cast("struct<scale: float, q: array<tinyint>>").alias("vector"), F.lit("").alias("model"))
    return cut(chunks.embed_chunks(rows, models.hash_embedder, "hash64"))


@query()
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    every = _indexed(spark, sf)
    return search.hybrid_search(_asked(spark, sf), every, chunks.build_postings(every), "hash64")


@query(f"""WITH {_CHUNKS}, dq AS (SELECT item_id AS qid, 'o' || (item_id % 7) AS owner_id, strftime(DATE '2024-01-05' + CAST(item_id % 5 + k AS INT), '%Y-%m-%d') AS day FROM benchmark, range(0, 7) r(k))
SELECT qid, c.day AS day, c.hash AS hash FROM dq JOIN c ON c.owner_id = dq.owner_id AND c.day = dq.day WHERE c.kind = 'DAY'""")
def day_digest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("item_id") % 5).cast("int"))
    days = fixtures.read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("o"), (F.col("item_id") % 7).cast("string")).alias("owner_id"), F.explode(F.sequence(start, F.date_add(start, 6))).alias("d"))
    every = turn_chunks(spark, sf)
    found = search.day_digest_chunks(every, days.select("qid", "owner_id", F.date_format("d", "yyyy-MM-dd").alias("day")))
    return found.join(every.select(F.col("id").alias("chunk_id"), "hash"), "chunk_id").select("qid", "day", "hash")


@query(f"WITH {T} SELECT id, text FROM t WHERE id % 3 = 0")
def fetch_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf)
    return search.fetch_chunks(t, t.filter("id % 3 = 0").select(F.col("id").alias("chunk_id"))).select("id", "text")


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    q = search.question_stems(fixtures.questions(spark, sf).filter("qid >= 1000"))
    t = _turns(spark, sf)
    hits = search.hybrid_search(q, t, chunks.build_postings(t))
    rows = hits.join(t.withColumnRenamed("id", "chunk_id"), "chunk_id").withColumnRenamed("chunk_id", "id")
    return context.build_contexts(q, rows, 900, ZONE)


@query()
def build_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf).select("qid", "user_prompt", joined(F.transform("sources", lambda s: s["chunk_id"].cast("string"))).alias("sources"))


_LABEL = "list_extract(['понедельник', 'вторник', 'среда', 'четверг', 'пятница', 'суббота', 'воскресенье'], isodow(CAST(day AS DATE))) || ', ' || day(CAST(day AS DATE)) || ' ' || list_extract(['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'], month(CAST(day AS DATE))) || ' ' || year(CAST(day AS DATE))"


@query(f"""WITH {_CHUNKS}, m AS (SELECT *, strftime(make_timestamp((start_ms + 10800000) * 1000), '%H:%M') AS a, strftime(make_timestamp((CAST(end_ms AS BIGINT) + 10800000) * 1000), '%H:%M') AS b FROM c)
SELECT hash, {_LABEL} || CASE kind WHEN 'DAY' THEN ', итог дня' WHEN 'HOUR' THEN ', сводка ' || a || '–' || b ELSE ', ' || CASE WHEN a = b THEN a ELSE a || '–' || b END || ', расшифровка' END AS label FROM m""")
def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    return context.source_labels(turn_chunks(spark, sf), MSK).select("hash", "label")


@query()
def answer_questions(spark: SparkSession, sf: str) -> DataFrame:
    answered = context.answer_questions(_contexts(spark, sf), models.citing_llm)
    return context.cited_sources(answered).select("qid", "answer", joined(F.transform("cited", lambda s: s["label"])).alias("cited"))


_TURN = "conv_id * 100 + turn AS id"


@query(f"SELECT {_TURN}, CASE length(text) % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(length(text) % 97 AS VARCHAR) ELSE length(text) % 97 || '|' || (length(text) % 97 + 1) END AS cited FROM conversations")
def extract_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns as answers, with citations behind their text."""
    size, text = F.char_length("text"), F.col("text")
    n = (size % 97).cast("string")
    answer = F.when(size % 3 == 0, F.concat(text, F.lit(" [x] [123]"))).when(size % 3 == 1, F.concat(F.lit("["), n, F.lit("] "), text, F.lit(" ["), n, F.lit("]"))).otherwise(F.concat(text, F.lit("["), n, F.lit(" ; "), (size % 97 + 1).cast("string"), F.lit("]")))
    return fixtures.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), joined(F.transform(context.extract_citations(answer), lambda x: x.cast("string"))).alias("cited"))


@query(f"SELECT {_TURN}, CASE length(text) % 2 WHEN 0 THEN '2' ELSE '1|2|3' END AS cited FROM conversations")
def cited_sources(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.concat("text", F.when(F.char_length("text") % 2 == 0, " [2]").otherwise(" [9]"))
    answers = fixtures.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), answer.alias("answer"), F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.struct(n.alias("n"))).alias("sources"))
    return context.cited_sources(answers).select("id", joined(F.transform("cited", lambda s: s["n"].cast("string"))).alias("cited"))


# ---- telemetry and segments


#: The bytes of a turn's text as samples of two bytes.
_PCM = "list_transform(list_transform(range(0, strlen(text) // 2), lambda k: CAST('0x' || substr(hex(encode(text)), 4 * k + 1, 2) AS INT) + 256 * CAST('0x' || substr(hex(encode(text)), 4 * k + 3, 2) AS INT)), lambda v: CASE WHEN v >= 32768 THEN v - 65536 ELSE v END)"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), segments.pcm_to_samples(F.col("text").cast("binary")).alias("pcm"))


@query(f"SELECT id, round(CASE WHEN rms > 0 THEN greatest(-96.0, least(0.0, 20 * log10(rms / 32767))) ELSE -96.0 END, 6) AS dbfs, coalesce(rms, 0) = 0 AS all_zero FROM (SELECT {_TURN}, sqrt(list_sum(list_transform({_PCM}, lambda x: CAST(x AS DOUBLE) * x)) / nullif(strlen(text) // 2, 0)) AS rms FROM conversations)")
def frame_level(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.frame_level(_samples(spark, sf)).select("id", F.round("dbfs", 6).alias("dbfs"), "all_zero")


@query(f"SELECT id, CAST(len(s) AS INT) AS n_samples, CAST(list_sum(s) AS BIGINT) AS total, list_min(s) AS least, list_max(s) AS most FROM (SELECT {_TURN}, {_PCM} AS s FROM conversations)")
def pcm_to_samples(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("pcm", F.lit(0).cast("long"), lambda a, x: a + x)
    return _samples(spark, sf).select("id", F.size("pcm").alias("n_samples"), F.when(F.size("pcm") > 0, total).alias("total"), F.array_min("pcm").cast("int").alias("least"), F.array_max("pcm").cast("int").alias("most"))


_W = f"""{FRAMES_SQL}, w AS (SELECT owner_id, frame_start_ms // 60000 * 60000 AS window_ms, count(*) AS frames, CAST(sum(n_samples) AS BIGINT) * 1000 // 16000 AS audio_ms,
  CAST(sum(CASE WHEN NOT screen_on THEN n_samples ELSE 0 END) AS BIGINT) * 1000 // 16000 AS screen_off_ms, CAST(sum(CASE WHEN silenced THEN n_samples ELSE 0 END) AS BIGINT) * 1000 // 16000 AS silenced_ms,
  count(*) FILTER (all_zero) AS zero_frames, round(avg(dbfs), 6) AS avg_dbfs FROM f GROUP BY ALL)"""


@query(f"WITH {_W} SELECT *, round(audio_ms / 60000, 6) AS coverage FROM w")
def capture_windows(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.capture_windows(fixtures.frames(spark, sf)).withColumn("avg_dbfs", F.round("avg_dbfs", 6)).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {_W} SELECT owner_id, window_ms FROM w WHERE audio_ms / 60000 < 0.95 OR silenced_ms > 0")
def coverage_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.coverage_alerts(telemetry.capture_windows(fixtures.frames(spark, sf))).select("owner_id", "window_ms")


@query(f"WITH {FRAMES_SQL}, g AS (SELECT *, lag(screen_on) OVER w AS a, lag(silenced) OVER w AS b FROM f WINDOW w AS (PARTITION BY owner_id ORDER BY frame_start_ms, frame_no)) SELECT owner_id, frame_no, screen_on, silenced FROM g WHERE a IS NOT NULL AND (a <> screen_on OR b <> silenced)")
def state_changes(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.state_changes(fixtures.frames(spark, sf)).select("owner_id", "frame_no", "screen_on", "silenced")


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT *, silenced OR dbfs <= -96 AS q FROM f), h AS (SELECT *, frame_no - row_number() OVER (PARTITION BY owner_id, q ORDER BY frame_no) AS k FROM g)
SELECT owner_id, min(frame_start_ms) AS start_ms, max(frame_start_ms) + 32 AS end_ms, count(*) AS n_frames, max(frame_start_ms) + 32 - min(frame_start_ms) > 1000 AS alarm FROM h WHERE q GROUP BY owner_id, k""")
def silence_runs(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.silence_runs(fixtures.frames(spark, sf), 1000)


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT *, silenced OR dbfs <= -96 AS q FROM f), h AS (SELECT *, frame_no - row_number() OVER (PARTITION BY owner_id, q ORDER BY frame_no) AS k FROM g)
SELECT owner_id, min(frame_start_ms) AS start_ms, max(frame_start_ms) + 32 AS end_ms, count(*) AS n_frames, max(frame_start_ms) + 32 - min(frame_start_ms) > 1000 AS alarm FROM h WHERE q GROUP BY owner_id, k""")
def silence_runs_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Files in the order of time; a silent frame of another owner a day later closes every run, and is still open itself."""
    rows = fixtures.frames(spark, sf)
    later = rows.groupBy().agg(F.max("frame_start_ms").alias("ms")).select(F.lit("clock").alias("owner_id"), F.lit(0).cast("long").alias("frame_no"), (F.col("ms") + DAY_MS).alias("frame_start_ms"), F.lit(0.0).alias("prob"), F.lit(-96.0).alias("dbfs"), F.lit(True).alias("screen_on"), F.lit(False).alias("silenced"), F.lit(True).alias("all_zero"), F.lit(512).alias("n_samples"))
    return _streamed(rows, lambda stream: jobs.silence_runs_stream(stream, 1000), "append", later, "frame_start_ms")


_SEG = f"""RECURSIVE {FRAMES_SQL},
n AS MATERIALIZED (SELECT owner_id, frame_start_ms AS ms, prob >= 0.5 AS hi, prob < 0.35 AS lo, row_number() OVER (PARTITION BY owner_id ORDER BY frame_start_ms) AS i FROM f),
st AS (
  SELECT DISTINCT owner_id, CAST(0 AS BIGINT) AS i, false AS inside, 0 AS pre, CAST(NULL AS BIGINT) AS b, 0 AS size, 0 AS speech, 0 AS quiet, 0 AS o, CAST(NULL AS BIGINT) AS ob, 0 AS os, 0 AS osp, CAST(NULL AS BIGINT) AS oms FROM n
  UNION ALL
  SELECT owner_id, i, CASE WHEN was THEN q < 22 ELSE hi END, CASE WHEN was OR hi THEN 0 ELSE least(pre + 1, 10) END,
         CASE WHEN was THEN CASE WHEN q >= 22 OR z >= 875 THEN NULL ELSE nb END WHEN hi THEN ms - pre * 32 END,
         CASE WHEN was THEN CASE WHEN q >= 22 OR z >= 875 THEN 0 ELSE z END WHEN hi THEN pre + 1 ELSE 0 END,
         CASE WHEN was THEN CASE WHEN q >= 22 OR z >= 875 THEN 0 ELSE sp END WHEN hi THEN 1 ELSE 0 END,
         CASE WHEN was AND q < 22 AND z < 875 THEN q ELSE 0 END,
         CASE WHEN NOT was THEN 0 WHEN q >= 22 THEN 1 WHEN z >= 875 THEN 2 ELSE 0 END, nb, CASE WHEN q >= 22 THEN z - 15 ELSE z END, sp, ms
  FROM (SELECT n.owner_id AS owner_id, n.i AS i, n.ms AS ms, n.hi AS hi, st.inside AS was, st.pre AS pre, coalesce(st.b, n.ms) AS nb, st.size + 1 AS z,
               st.speech + CASE WHEN n.hi THEN 1 ELSE 0 END AS sp, CASE WHEN n.hi THEN 0 WHEN n.lo THEN st.quiet + 1 ELSE st.quiet END AS q
        FROM st JOIN n ON n.owner_id = st.owner_id AND n.i = st.i + 1)),
fl AS (SELECT st.* FROM st JOIN (SELECT owner_id, max(i) AS i FROM n GROUP BY owner_id) e ON e.owner_id = st.owner_id AND e.i = st.i WHERE st.inside),
sg AS (SELECT owner_id, ob AS start_ms, CAST(os AS BIGINT) AS n_frames, CAST(osp * 32 AS BIGINT) AS speech_ms, o = 2 AS split_by_max, oms AS close_ms, o = 1 AND osp < 13 AS dropped FROM st WHERE o > 0
  UNION ALL SELECT owner_id, b, CAST(size - least(greatest(quiet - 7, 0), size) AS BIGINT), CAST(speech * 32 AS BIGINT), false, oms, speech < 13 FROM fl WHERE size - least(greatest(quiet - 7, 0), size) > 0)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return segmentation.segment_speech(fixtures.frames(spark, sf))


@query(f"WITH {_SEG} SELECT * FROM sg")
def segment_speech(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf)


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT *, coalesce(frame_start_ms - lag(frame_start_ms) OVER w > 60000, true) AS opens FROM f WINDOW w AS (PARTITION BY owner_id ORDER BY frame_start_ms)),
h AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY owner_id ORDER BY frame_start_ms) AS session FROM g)
SELECT owner_id, frame_no, round(max((dbfs + 96) / 96) OVER (PARTITION BY owner_id, session ORDER BY frame_start_ms), 9) AS prob FROM h""")
def score_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in with a state: the loudest level of the session so far."""

    def loudest(part: pd.DataFrame, state: float | None) -> tuple[pd.Series, float]:
        level = part["dbfs"].add(96).div(96)
        prob = level.cummax() if state is None else level.cummax().clip(lower=state)
        return prob, float(prob.iloc[-1])

    return segmentation.score_frames(fixtures.frames(spark, sf), loudest).select("owner_id", "frame_no", F.round("prob", 9).alias("prob"))


@query(f"""WITH {_SEG}, au AS (SELECT owner_id, (frame_start_ms + 10800000) // 3600000 * 3600000 - 10800000 AS hour_ms, CAST(sum(n_samples) AS BIGINT) * 1000 // 16000 AS audio_ms FROM f GROUP BY ALL),
hs AS (SELECT owner_id, close_ms // 3600000 * 3600000 AS hour_ms, CAST(coalesce(sum(n_frames * 32) FILTER (NOT dropped), 0) AS BIGINT) AS speech_ms, count(*) FILTER (NOT dropped) AS segments, count(*) FILTER (dropped) AS dropped_short FROM sg GROUP BY ALL)
SELECT au.owner_id, au.hour_ms, au.audio_ms, coalesce(speech_ms, 0) AS speech_ms, coalesce(segments, 0) AS segments, coalesce(dropped_short, 0) AS dropped_short, round(coalesce(speech_ms, 0) / au.audio_ms, 9) AS speech_share FROM au LEFT JOIN hs ON au.owner_id = hs.owner_id AND au.hour_ms = hs.hour_ms""")
def hourly_speech(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.hourly_speech(fixtures.frames(spark, sf), _segments(spark, sf), MSK).withColumn("speech_share", F.round("speech_share", 9))


@query(f"WITH {_SEG} SELECT owner_id, start_ms, CAST(sum(n_frames * 32) OVER w AS BIGINT) AS total_speech_ms, count(*) OVER w AS total_segments FROM sg WHERE NOT dropped WINDOW w AS (PARTITION BY owner_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def session_totals(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.session_totals(_segments(spark, sf).filter("NOT dropped")).select("owner_id", "start_ms", "total_speech_ms", "total_segments")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a segment in the buffer."""
    t = fixtures.transcripts(spark, sf)
    return t.select("owner_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), ((F.col("end_ms") - F.col("start_ms")) * 32 + 50).alias("size"), "id", "text")


@query(f"WITH {T} SELECT owner_id, start_ms, id FROM t WHERE id % 4 <> 0 AND (owner_id, start_ms) NOT IN (SELECT (owner_id, start_ms) FROM t WHERE id % 4 = 0)")
def pending_segments(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return buffer.pending_segments(files, files.filter("id % 4 = 0")).select("owner_id", "start_ms", "id")


@query(f"WITH {T} SELECT owner_id, count(*) AS segments, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms, CAST(sum((end_ms - start_ms) * 32 + 50) AS BIGINT) AS bytes FROM t GROUP BY owner_id")
def buffer_stats(spark: SparkSession, sf: str) -> DataFrame:
    return buffer.buffer_stats(_files(spark, sf))


@query(f"WITH {T}, z AS (SELECT owner_id, id, sum((end_ms - start_ms) * 32 + 50) OVER w AS total, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY owner_id ORDER BY start_ms DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT owner_id, id FROM z WHERE total <= 20000000 OR n = 1")
def retain_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return buffer.retain_by_size(_files(spark, sf), ["owner_id"], [F.desc("start_ms"), "id"], "size", 20_000_000, F.floor(F.col("start_ms") / DAY_MS))[0].select("owner_id", "id")


_PATHS = {"view": "/data/segments/{}.bseg", "signup": "/data/{}.WAV", "click": "/data/segments/{}.bseg.tmp", "error": "/data/models/{}.wav", "purchase": "/cache/{}.bseg"}


@query("SELECT class, count(*) AS files FROM (SELECT CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN NULL ELSE 'stray' END AS class FROM events) WHERE class IS NOT NULL GROUP BY class")
def leftover_audio(spark: SparkSession, sf: str) -> DataFrame:
    name = F.create_map(*[F.lit(x) for pair in _PATHS.items() for x in pair])[F.col("event_type")]
    return buffer.leftover_audio(fixtures.read(spark, sf, "events").select(F.replace(name, F.lit("{}"), F.col("user_id").cast("string")).alias("path")))


@query(f"SELECT {_TURN}, 1704067200000 + turn AS start_ms, CAST(strlen(text) // 2 * 2 AS BIGINT) AS bytes_back, 'ok' AS status FROM conversations")
def seal_and_open_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of whole turns sealed as samples, the header read in the clear, opened again."""
    key = bytes(range(32))
    rows = fixtures.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.lit(D0) + F.col("turn")).alias("start_ms"), F.lit(16_000).alias("sample_rate"), segments.pcm_to_samples(F.col("text").cast("binary")).alias("pcm"))
    rows = rows.select("id", "start_ms", "sample_rate", F.size("pcm").alias("num_samples"), segments.samples_to_pcm("pcm").alias("pcm_bytes"))
    sealed = segments.seal_segments(rows, key).select("id", F.col("blob").alias("content"))
    opened = segments.open_segments(segments.header_columns(sealed), key)
    return opened.select("id", "start_ms", F.octet_length("pcm_bytes").cast("long").alias("bytes_back"), "status")


@query()
def whole_path(spark: SparkSession, sf: str) -> DataFrame:
    """Frames to segments, sealed files, transcripts, digests, the index, and cited answers to every benchmark passage. A segment's audio are the bytes of a whole turn, and the stand-in recognizer reads them."""
    key, folder, path = bytes(range(32)), shared_path(spark, "buffer"), shared_path(spark, "diary")
    turns = fixtures.read(spark, sf, "conversations").filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    n = turns.agg(F.max("conv_id") + 1).first()[0]

    def audio(found: DataFrame) -> DataFrame:
        said = turns.select("conv_id", F.when(F.octet_length("text") % 2 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")).cast("binary").alias("pcm_bytes"))
        return found.withColumn("conv_id", F.pmod(F.xxhash64("owner_id", "start_ms"), F.lit(n))).join(said, "conv_id").drop("conv_id")

    def hear(payload: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": payload.map(lambda b: bytes(b).decode()), "lang": "", "took_ms": payload.map(len)})

    diary_path.buffer_speech(fixtures.frames(spark, sf), audio, folder, key)
    diary_path.transcribe_buffer(spark, folder, key, path, hear, ZONE, "asr", NOW_MS)
    diary_path.summarize_diary(spark, path, models.first_words_llm, ZONE, NOW_MS, 4000)
    store = chunk_store.ChunkStore(spark, shared_path(spark, "index"))
    diary_path.index_diary(spark, path, store, models.hash_embedder, "hash64", ZONE, NOW_MS)
    users = fixtures.read(spark, sf, "events").agg(F.max("user_id") + 1).first()[0]
    asked = fixtures.questions(spark, sf).filter("qid >= 1000").withColumn("owner_id", F.concat(F.lit("u"), (F.col("qid") % users).cast("string")))
    answers = diary_path.ask(asked, store, models.hash_embedder, "hash64", models.citing_llm, ZONE, 900)
    return answers.select("qid", "answer", joined(F.transform("cited", lambda s: s["label"])).alias("cited"))


# ---- transcription, calls, logs


@query(f"WITH {T} SELECT owner_id, id, trim(text, E' \\n') AS text, CAST(length(text) AS BIGINT) AS took_ms FROM t")
def transcribe(spark: SparkSession, sf: str) -> DataFrame:
    def hear(payload: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": payload, "lang": "", "took_ms": payload.str.len()})

    rows = _files(spark, sf).withColumn("payload", F.col("text")).drop("text")
    return transcription.transcribe(rows, hear).select("owner_id", "id", "text", "took_ms")


@query(f"WITH {T} SELECT owner_id, start_ms, strftime(make_timestamp((start_ms + 10800000) * 1000), '%Y-%m-%d') AS day, trim(text, E' \\n') AS text, {NOW_MS} AS created_ms FROM t WHERE id % 5 <> 0")
def to_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    results = _files(spark, sf).select("owner_id", "start_ms", "end_ms", F.when(F.col("id") % 5 == 0, "   ").otherwise(F.col("text")).alias("text"), F.lit("").alias("lang"))
    return transcription.to_transcripts(results, MSK, "asr", NOW_MS).select("owner_id", "start_ms", "day", "text", "created_ms")


@query(f"""WITH {T}, r AS (SELECT end_ms - start_ms AS d, id % 5 = 0 AS blank, id % 7 = 0 AS shut FROM t)
SELECT count(*) FILTER (NOT shut) AS processed, count(*) FILTER (blank AND NOT shut) AS empty, count(*) FILTER (shut) AS undecryptable, CAST(sum(d) FILTER (NOT shut) AS BIGINT) AS audio_ms, count(*) FILTER (NOT shut) * 50 AS processing_ms, round(count(*) FILTER (NOT shut) * 50.0 / sum(d) FILTER (NOT shut), 9) AS rtf FROM r""")
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    results = _files(spark, sf).select("duration_ms", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"), F.lit(50).alias("took_ms"))
    return transcription.run_report(results).withColumn("rtf", F.round("rtf", 9))


@query(f"""WITH u AS (SELECT epoch_us(ts) // 1000 AS ts_ms, user_id AS device_id, CAST(round(CASE WHEN event_id % 20 = 0 THEN 0 WHEN event_id % 10 = 0 THEN value / 1000 ELSE value * 1000 END * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS c FROM events),
i AS (SELECT device_id * 100000 + ts_ms // {DAY_MS} AS run_id, CASE WHEN abs(c) < 1000 THEN abs(c) ELSE abs(c) / 1000 END AS ma FROM u WHERE c <> 0 AND ts_ms % {DAY_MS} BETWEEN 21600000 AND 64800000)
SELECT run_id, count(*) AS samples, round(avg(ma), 6) AS avg_ma, round(avg(ma) * 12, 6) AS mah FROM i GROUP BY run_id""")
def energy_report(spark: SparkSession, sf: str) -> DataFrame:
    return transcription.energy_report(fixtures.current_samples(spark, sf), fixtures.runs(spark, sf)).withColumn("avg_ma", F.round("avg_ma", 6)).withColumn("mah", F.round("mah", 6))


@query("""WITH c AS (SELECT user_id AS run_id, event_type AS model, CAST(floor(value) AS BIGINT) AS pt, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS pm, CAST(floor(value / 4) AS BIGINT) AS gt, CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 AS gm FROM events)
SELECT run_id, model, count(*) AS calls, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(gt) AS BIGINT) AS gen_tokens, round(CASE WHEN sum(pm) > 0 THEN sum(pt) * 1000.0::DOUBLE / sum(pm) ELSE 0 END, 6) AS prompt_tps, round(CASE WHEN sum(gm) > 0 THEN sum(gt) * 1000.0::DOUBLE / sum(gm) ELSE 0 END, 6) AS gen_tps FROM c GROUP BY run_id, model""")
def llm_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return transcription.llm_throughput(fixtures.llm_calls(spark, sf)).withColumn("prompt_tps", F.round("prompt_tps", 6)).withColumn("gen_tps", F.round("gen_tps", 6))


_L = "l AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS time_ms, CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'W' WHEN 'signup' THEN 'D' ELSE 'I' END AS level, event_type AS tag, props AS message FROM events)"


@query(f"WITH {_L} SELECT seq, level, tag FROM l WHERE level IN ('W', 'E') AND time_ms >= {NOW_MS} - 86400000")
def filter_logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.filter_logs(fixtures.logs(spark, sf), "W", NOW_MS).select("seq", "level", "tag")


@query(f"""WITH {_L}, h AS (SELECT time_ms // 3600000 AS hour, sum(strlen(level || tag || message) + 22) AS size FROM l WHERE time_ms // 3600000 >= {NOW_MS // 3_600_000 - 24} GROUP BY 1),
k AS (SELECT hour, sum(size) OVER w AS total, row_number() OVER w AS n FROM h WINDOW w AS (ORDER BY hour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seq, level FROM l WHERE time_ms // 3600000 IN (SELECT hour FROM k WHERE total <= 20000 OR n = 1)""")
def retain_logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.retain_logs(fixtures.logs(spark, sf), NOW_MS, 20_000).select("seq", "level")


@query("SELECT event_id AS seq, event_type AS tag FROM events ORDER BY event_id DESC LIMIT 3000")
def tail_logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.tail_logs(fixtures.logs(spark, sf)).select("seq", "tag")


@query("SELECT event_id AS seq, CASE WHEN event_id % 4 = 0 THEN '' ELSE '01-02 03:04:05.678' END AS ts_text, CASE WHEN event_id % 4 = 0 THEN 'D' WHEN event_type = 'error' THEN 'E' ELSE 'I' END AS level, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS tag, CASE WHEN event_id % 4 = 0 THEN '    at ' || props ELSE props END AS message FROM events")
def parse_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    head = F.concat(F.lit("01-02 03:04:05.678 "), F.when(F.col("event_type") == "error", "E").otherwise("I"), F.lit("/"), "event_type", F.lit(": "), "props")
    lines = fixtures.read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("    at "), "props")).otherwise(head).alias("value"))
    return loglines.parse_log_lines(lines, keep=["seq"])


@query("""WITH c AS (SELECT p_partkey AS ord, 'm' || p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN sha256(CAST(p_partkey % 40 AS VARCHAR)) END AS h, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS n FROM part),
f AS (SELECT p_partkey AS path, upper(sha256(CAST(p_partkey % 60 AS VARCHAR))) AS s, p_name AS n FROM part)
SELECT f.path AS path, coalesce(a.e.id, b.e.id) AS entry, CASE WHEN a.e IS NOT NULL THEN 'hash' WHEN b.e IS NOT NULL THEN 'name' END AS matched_by FROM f
LEFT JOIN (SELECT lower(h) AS h, min(struct_pack(ord := ord, id := id)) AS e FROM c WHERE h IS NOT NULL GROUP BY 1) a ON lower(f.s) = a.h
LEFT JOIN (SELECT n, min(struct_pack(ord := ord, id := id)) AS e FROM c WHERE n IS NOT NULL GROUP BY 1) b ON f.n = b.n""")
def identify_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    part = fixtures.read(spark, sf, "part")
    k = F.col("p_partkey")
    sha = lambda m: F.sha2((k % m).cast("string").cast("binary"), 256)
    catalog = part.select(k.alias("ord"), F.concat(F.lit("m"), k.cast("string")).alias("id"), F.when(k % 3 != 0, sha(40)).alias("sha256"), F.when(k % 2 == 0, F.col("p_name")).alias("name"))
    files = part.select(k.alias("path"), F.upper(sha(60)).alias("sha256"), F.col("p_name").alias("name"))
    return logs.identify_artifacts(files, catalog).select("path", "entry", "matched_by")


@query(f"WITH {T} SELECT owner_id, start_ms, id FROM t WHERE id % 3 <> 0")
def append_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """What a second, overlapping batch adds."""
    t = fixtures.transcripts(spark, sf)
    return diary.new_transcripts(t.filter("id % 3 = 0"), t).select("owner_id", "start_ms", "id")


@query(f"WITH {T} SELECT owner_id, start_ms, id, day, text FROM t")
def append_transcripts_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every transcript told twice, half an hour of diary time apart, and a third time by a second stream over the same files: the table has each once."""
    t = fixtures.transcripts(spark, sf).drop("role")
    source, path, logs_ = (shared_path(spark, x) for x in ("told", "diary", "log"))
    told = t.withColumn("told_ms", F.col("created_ms")).unionByName(t.withColumn("told_ms", F.col("created_ms") + 1_800_000))
    for part in range(3):
        told.filter(F.pmod(F.col("id") + F.floor(F.col("told_ms") / 1_800_000), F.lit(3)) == part).drop("told_ms").coalesce(2).write.mode("append").parquet(source)
    for run in range(2):  # the second one starts without a checkpoint: its batches are in the ledger
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(source)
        jobs.append_stream(stream, path, f"{logs_}-{run}", delay="100 days").awaitTermination()
    return diary.read_table(spark, path, "transcripts").select("owner_id", "start_ms", "id", "day", "text")


@query(f"WITH {T} SELECT owner_id, id, day, text FROM t WHERE NOT (day = '{CUT_DAY}' AND id % 2 = 0)")
def write_and_read_day(spark: SparkSession, sf: str) -> DataFrame:
    """All days written, one written anew with fewer rows, and the table read back."""
    t = fixtures.transcripts(spark, sf)
    path = shared_path(spark, "diary")
    diary.write_day(t, path, "transcripts")
    diary.write_day(t.filter(f"day = '{CUT_DAY}' AND id % 2 = 1"), path, "transcripts")
    return diary.read_table(spark, path, "transcripts").select("owner_id", "id", "day", "text")


@query(f"""WITH {_CHUNKS}, td AS (SELECT owner_id, day FROM t UNION SELECT owner_id, day FROM s)
SELECT 'transcripts' AS name, owner_id, day, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'summaries', owner_id, day, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'chunks', owner_id, day, count(*) FROM c GROUP BY ALL
UNION ALL SELECT 'index_days', owner_id, day, 1 FROM td WHERE CAST(right(day, 2) AS INT) % 5 <> 0""")
def read_diary(spark: SparkSession, sf: str) -> DataFrame:
    """The four tables written by days and read again: rows of each day."""
    path = shared_path(spark, "diary")
    tables = {"transcripts": fixtures.transcripts(spark, sf), "summaries": fixtures.summaries(spark, sf), "chunks": turn_chunks(spark, sf), "index_days": _index_days(spark, sf)}
    for name, rows in tables.items():
        diary.write_day(rows, path, name)
    counted = [rows.groupBy("owner_id", "day").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "owner_id", "day", "n") for name, rows in diary.read_diary(spark, path).items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


def _streamed(df: DataFrame, made: Callable[[DataFrame], DataFrame], mode: str, then: DataFrame | None = None, along: str | None = None) -> DataFrame:
    """What a stream over the rows of df gives, in several batches, the rows of `then` in a file of their own after them: all batches' rows, or the last state of a complete result.

    With `along`, files come in the order of that column, each with the rows of a stretch of it.
    """
    spark = df.sparkSession
    source, sink, log = (shared_path(spark, x) for x in ("stream-in", "stream-out", "stream-log"))
    if along is None:
        df.repartition(4).write.parquet(source)
    else:
        df = cut(df)
        cuts = df.approxQuantile(along, [k / 6 for k in range(1, 6)], 0.01)
        for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
            stretch = df if lo is None else df.filter(F.col(along) >= lo)
            (stretch if hi is None else stretch.filter(F.col(along) < hi)).coalesce(1).write.mode("append").parquet(source)
    if then is not None:
        then.coalesce(1).write.mode("append").parquet(source)
    stream = made(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(source))

    def put(batch: DataFrame, k: int) -> None:
        # a batch that is run again replaces what it wrote; each complete result replaces the one before
        batch.write.mode("overwrite").parquet(f"{sink}/batch={k if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink).drop("batch")


@query(f"WITH {_SEG} SELECT * FROM sg")
def segment_speech_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The files come in the order of time, as a live source's do, so the watermark is ten seconds behind; a frame of another size in the end, which is skipped, moves it past every owner's last one."""
    jobs.rocksdb_state(spark)
    rows = fixtures.frames(spark, sf).select("owner_id", "frame_start_ms", "prob", "n_samples")
    later = rows.groupBy().agg(F.max("frame_start_ms").alias("ms")).select(F.lit("clock").alias("owner_id"), (F.col("ms") + DAY_MS).alias("frame_start_ms"), F.lit(0.0).alias("prob"), F.lit(0).alias("n_samples"))
    return _streamed(rows, jobs.segment_speech_stream, "append", later, "frame_start_ms")


@query(f"WITH {T} SELECT owner_id, start_ms, CAST((end_ms - start_ms) // 10 AS INT) AS num_samples, 'ok' AS status, CAST((end_ms - start_ms) // 10 AS BIGINT) * 2 + 50 AS size, CAST((end_ms - start_ms) // 10 AS BIGINT) * 1000 // 16000 AS duration_ms FROM t")
def scan_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn sealed and written to a file of its own in its owner's folder; then the folders scanned."""
    n = F.floor((F.col("end_ms") - F.col("start_ms")) / 10).cast("int")
    turns = fixtures.transcripts(spark, sf).select("owner_id", "id", "start_ms", F.lit(16_000).alias("sample_rate"), n.alias("num_samples"))
    pcm = segments.samples_to_pcm(F.transform(F.sequence(F.lit(1), F.col("num_samples")), lambda k: (k * 31 % 2000 - 1000).cast("smallint")))
    folder = shared_path(spark, "segments")
    name = F.concat("owner_id", F.lit("/"), F.col("id").cast("string"), F.lit(".bseg"))
    segments.write_segments(segments.seal_segments(turns.withColumn("pcm_bytes", pcm), bytes(range(16))).select(name.alias("name"), "blob"), folder)
    return segments.scan_segments(spark, folder).select(F.element_at(F.split("path", "/"), -2).alias("owner_id"), "start_ms", "num_samples", "status", "size", "duration_ms")


@query(f"WITH {T} SELECT owner_id, day, count(*) AS count, max(created_ms) AS max_created_ms FROM t GROUP BY owner_id, day")
def day_stats_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(fixtures.transcripts(spark, sf), jobs.day_stats_stream, "complete")


@query(f"WITH {_W} SELECT owner_id, window_ms, frames, audio_ms, zero_frames FROM w")
def capture_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(fixtures.frames(spark, sf), jobs.capture_windows_stream, "complete").select("owner_id", "window_ms", "frames", "audio_ms", "zero_frames")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)
