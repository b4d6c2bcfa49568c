import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook import registry
from daybook.functions import models, textops, timeutil, vectors
from daybook.operators import buffer, chunks, context, dates, digests, logs, search, segmentation, summaries, telemetry, transcription, vector_index
from daybook.plans import summarize
from daybook.sources import diary, segments

MSK = "Europe/Moscow"
DAY0 = int(dt.datetime(2026, 9, 29, tzinfo=dt.timezone(dt.timedelta(hours=3))).timestamp() * 1000)


def at(h, m, s=0):
    return DAY0 + (h * 3600 + m * 60 + s) * 1000


def probs(spark, spec, owner="o", start=0):
    values = [p for n, p in spec for _ in range(n)]
    return spark.createDataFrame([(owner, start + 32 * k, float(p), 512) for k, p in enumerate(values)], "owner_id string, frame_start_ms long, prob double, n_samples int")


def plain_segments(values, first=0):
    """Frame by frame, as the rules are written down."""
    pre, cur, out, dropped, inside, speech, quiet = [], [], [], 0, False, 0, 0
    done = []

    def finish(split):
        nonlocal dropped
        if cur:
            if speech < 13 and not split:
                dropped += 1
            else:
                done.append((cur[0], len(cur), speech * 32, split))

    for k, p in enumerate(values):
        ms = first + 32 * k
        if not inside:
            if p >= 0.5:
                inside, cur, speech, quiet, pre = True, [*pre, ms], 1, 0, []
            else:
                pre = [*pre, ms][-10:]
            continue
        cur.append(ms)
        if p >= 0.5:
            speech, quiet = speech + 1, 0
        elif p < 0.35:
            quiet += 1
        if quiet >= 22:
            del cur[len(cur) - 15 :]
            finish(False)
            inside, cur, speech, quiet = False, [], 0, 0
        elif len(cur) >= 875:
            finish(True)
            cur, speech, quiet = [], 0, 0
    if inside:
        cut = min(max(quiet - 7, 0), len(cur))
        del cur[len(cur) - cut :]
        finish(False)
    return sorted(done), dropped


def found_segments(df):
    rows = segmentation.segment_speech(df).collect()
    return sorted((r.start_ms, r.n_frames, r.speech_ms, r.split_by_max) for r in rows if not r.dropped), sum(r.dropped for r in rows)


@pytest.mark.parametrize("spec", [[(50, 0.1)], [(50, 0.1), (40, 0.9), (30, 0.1)], [(20, 0.1), (10, 0.9), (30, 0.1)], [(10, 0.1), (30, 0.9), (15, 0.1), (30, 0.9), (30, 0.1)], [(30, 0.9), (40, 0.4), (30, 0.1)], [(1850, 0.95)]])
def test_segmenter_cases(spark, spec):
    values = [p for n, p in spec for _ in range(n)]
    assert found_segments(probs(spark, spec)) == plain_segments(values)


def test_segmenter_example(spark):
    (segment,), dropped = found_segments(probs(spark, [(50, 0.1), (40, 0.9), (30, 0.1)]))
    assert segment == (1280, 57, 1280, False) and dropped == 0


def test_islands_equal_the_whole(spark):
    rng = random.Random(3)
    frames, expected, gone = None, {}, 0
    for k in range(12):
        spec = [(rng.choice([1, 5, 20, 30, 53, 60, 120, 900]), rng.choice([0.1, 0.1, 0.4, 0.9])) for _ in range(25)]
        df = probs(spark, spec, f"o{k}", 1_000_000 * k)
        frames = df if frames is None else frames.unionByName(df)
        done, dropped = plain_segments([p for n, p in spec for _ in range(n)], 1_000_000 * k)
        expected[f"o{k}"], gone = done, gone + dropped
    rows = segmentation.segment_speech(frames).collect()
    for owner, done in expected.items():
        assert sorted((r.start_ms, r.n_frames, r.speech_ms, r.split_by_max) for r in rows if r.owner_id == owner and not r.dropped) == done
    assert sum(r.dropped for r in rows) == gone


def test_stream_equals_batch(spark, tmp_path):
    from daybook.streaming.jobs import rocksdb_state, segment_speech_stream

    rocksdb_state(spark)
    df = probs(spark, [(20, 0.1), (40, 0.9), (60, 0.1), (30, 0.9), (40, 0.1)], "a", 1_000_000).unionByName(probs(spark, [(900, 0.9), (60, 0.1)], "b", 1_000_000))
    tail = spark.createDataFrame([("z", 10_000_000 + 32 * k, 0.1, 512) for k in range(3)], df.schema)
    source = str(tmp_path / "in")
    df.repartition(1).write.parquet(source)
    stream = segment_speech_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        for k in range(3):
            tail.withColumn("frame_start_ms", F.col("frame_start_ms") + k * 1_000_000).repartition(1).write.mode("append").parquet(source)
            query.processAllAvailable()
        got = {tuple(r) for r in spark.table("segments").collect()}
    finally:
        query.stop()
    assert got == {tuple(r) for r in segmentation.segment_speech(df).collect()}


def test_hour_and_capture_stats(spark):
    base = 1000 * 3_600_000
    frames = spark.createDataFrame([("o", 0, base, 60 * 16_000), ("o", 1, base + 60_000, 60 * 16_000), ("o", 2, base + 3_600_000, 16_000)], "owner_id string, frame_no long, frame_start_ms long, n_samples int")
    segs = spark.createDataFrame([("o", base, 188, base + 1, False), ("o", base, 375, base + 2, False), ("o", base, 3, base + 3, True)], "owner_id string, start_ms long, n_frames long, close_ms long, dropped boolean")
    first, second = telemetry.hourly_speech(frames, segs, "UTC").orderBy("hour_ms").collect()
    assert (first.audio_ms, first.segments, first.dropped_short, first.speech_ms) == (120_000, 2, 1, 188 * 32 + 375 * 32)
    assert (second.audio_ms, second.speech_ms, second.speech_share) == (1000, 0, 0.0)
    levels = telemetry.frame_level(spark.createDataFrame([([32767, -32767] * 8,), ([0] * 8,), ([],)], "pcm array<smallint>")).collect()
    assert [round(r.dbfs, 6) for r in levels] == [0.0, -96.0, -96.0] and [r.all_zero for r in levels] == [False, True, True]


def test_segment_files_round_trip(spark, tmp_path):
    key = bytes(range(16))
    pcm = [((31 * i + 5) % 2000) - 1000 for i in range(160)]
    rows = spark.createDataFrame([(3000, 16_000, 160, pcm), (1000, 16_000, 160, pcm)], "start_ms long, sample_rate int, num_samples int, pcm array<smallint>")
    blobs = segments.seal_segments(rows.withColumn("pcm_bytes", segments.samples_to_pcm("pcm")), key).select("blob").collect()
    for k, r in enumerate(blobs):
        (tmp_path / f"{k}.bseg").write_bytes(bytes(r.blob))
    broken = bytearray(blobs[0].blob)
    broken[10] ^= 1
    (tmp_path / "t.bseg").write_bytes(bytes(broken))
    (tmp_path / "junk.bseg").write_bytes(b"\x09\x09")
    (tmp_path / "x.bseg.tmp").write_bytes(b"\x01\x02\x03")
    scanned = segments.scan_segments(spark, str(tmp_path))
    opened = segments.open_segments(scanned, key).withColumn("samples", segments.pcm_to_samples("pcm_bytes")).collect()
    by = {r.path.rsplit("/", 1)[1]: r for r in opened}
    assert set(by) == {"0.bseg", "1.bseg", "t.bseg", "junk.bseg"} and by["junk.bseg"].status == "short"
    assert by["0.bseg"].samples == pcm and (by["0.bseg"].start_ms, by["0.bseg"].duration_ms) == (3000, 10)
    assert by["t.bseg"].status == "ok" and by["t.bseg"].pcm_bytes is None
    assert segments.open_segments(scanned, bytes(16)).filter("pcm_bytes IS NOT NULL").isEmpty()


def test_retain_by_size(spark):
    df = spark.createDataFrame([("o", s * 1000, 3221) for s in range(5)] + [("p", 1, 10**6)], "owner_id string, start_ms long, size long")
    kept, dropped = buffer.retain_by_size(df, ["owner_id"], [F.desc("start_ms")], "size", 7000)
    assert {(r.owner_id, r.start_ms) for r in kept.collect()} == {("o", 4000), ("o", 3000), ("p", 1)} and dropped.count() == 3


def test_chunking(spark):
    def run(rows, **k):
        df = spark.createDataFrame([("o", "2026-09-29", n, a, b, t) for n, (a, b, t) in enumerate(rows)], "owner_id string, day string, id long, start_ms long, end_ms long, text string")
        return [r for r in chunks.chunk_transcripts(df, MSK, **k).orderBy("start_ms", "ord").collect()]

    ten = [(at(10, k), at(10, k, 20), " ".join(f"w{k}x{j}" for j in range(30))) for k in range(10)]
    assert [len(r.text.split("\n")) for r in run(ten, target=100, most=150)] == [4, 4, 2]
    assert [r.text for r in run([(at(10, 58), at(10, 59), "до часа"), (at(11, 1), at(11, 2), "после часа")])] == ["[10:58] до часа", "[11:01] после часа"]
    long = [(at(9, 0), at(9, 1), " ".join(f"s{j}" for j in range(400)))]
    got = run(long, target=100, most=150)
    assert [len(r.text.split()) - 1 for r in got] == [150, 150, 100] and " ".join(w for r in got for w in r.text.split()[1:]) == long[0][2]
    assert run([(at(9, 0), at(9, 1), "  ")]) == []


def test_sync_keeps_ids_and_vectors(spark):
    draft = lambda rows: chunks.hash_chunks(spark.createDataFrame([("o", "2026-09-29", "TRANSCRIPT", k, k + 1, t, k) for k, t in enumerate(rows)], "owner_id string, day string, kind string, start_ms long, end_ms long, text string, ord long"))
    kind = "struct<scale: float, q: array<tinyint>>"
    old = draft(["a", "b"]).withColumn("vector", F.struct(F.lit(1.0).cast("float").alias("scale"), F.array(F.lit(1).cast("tinyint")).alias("q")).cast(kind)).withColumn("model", F.lit("m"))
    new = draft(["a", "c"])
    days = spark.createDataFrame([("o", "2026-09-29")], "owner_id string, day string")
    after, report = chunks.sync_chunks(old, new, days, days)
    rows = {r.text: r for r in after.collect()}
    assert set(rows) == {"a", "c"} and rows["a"].vector is not None and rows["c"].vector is None
    assert [(r.added, r.removed) for r in report.collect()] == [(1, 1)]
    again, report = chunks.sync_chunks(after, new, days, days)
    assert again.count() == 2 and report.count() == 0
    assert chunks.sync_chunks(after, new, days.limit(0), days.limit(0))[0].count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((20, 256))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(99, [0.0] * 256)], "id long, v array<double>").withColumn("v", F.col("v").cast("array<float>"))
    rows = df.withColumn("p", vectors.quantize("v" and F.col("v"))).withColumn("d", vectors.dot(F.col("v"), F.col("p"))).withColumn("back", vectors.dequantize(F.col("p"))).collect()
    for r in rows:
        top = max(map(abs, r.v)) or 127
        assert max(abs(a - b) for a, b in zip(r.v, r.back)) < top / 127 and (r.id == 99 or abs(r.d - 1) < 0.01)


def halves(spark):
    """3/6 of 127 is 63.5 in floats, and a little less in doubles."""
    return spark.createDataFrame([(1, [0.03, 0.06])], "id long, v array<float>")


def test_quotients_are_floats(spark):
    assert halves(spark).select(vectors.quantize(F.col("v")).alias("p")).first().p.q == [64, 127]
    # the embeddings of chunks keep doubles, as their SQL has them
    assert halves(spark).select(vectors.quantize(F.col("v"), single=False).alias("p")).first().p.q == [63, 127]


def test_a_vector_comes_back_from_its_rounded_floats(spark):
    back = halves(spark).select(vectors.dequantize(vectors.quantize(F.col("v"))).alias("v")).first().v
    assert back[0] == pytest.approx(64 * 0.06 / 127, rel=1e-6)


def test_rrf_ties(spark):
    lists = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 3), (1, 1, 1, 3), (1, 1, 2, 4), (1, 1, 3, 1)], "qid long, list_no int, pos int, id long")
    rows = search.fuse_rrf(lists).orderBy("rank").collect()
    assert [r.id for r in rows][:2] == [1, 3] and abs(rows[0].score - (1 / 61 + 1 / 63)) < 1e-8


def test_stems_and_citations(spark):
    r = spark.range(1).select(textops.stems(F.lit("Что я обещал Саше?")).alias("s"), context.extract_citations(F.lit("Ты обещал позвонить [1]. Ещё [3, 4].")).alias("c"), timeutil.format_duration(F.lit(3_905_000)).alias("a"), timeutil.format_duration(F.lit(192_000)).alias("b")).first()
    assert r.s == ["обещ", "саш"] and r.c == [1, 3, 4] and (r.a, r.b) == ("1 ч 05 мин", "3 мин 12 с")


DATES = [("что было вчера", "2026-09-29", "2026-09-29"), ("в среду", "2026-09-23", "2026-09-30"), ("в прошлую пятницу", "2026-09-25", "2026-09-25"), ("5 декабря", "2025-12-05", "2025-12-05"), ("01.01.2025", "2025-01-01", "2025-01-01"), ("на прошлой неделе", "2026-09-21", "2026-09-27"), ("в прошлом месяце", "2026-08-01", "2026-08-31"), ("неделю назад", "2026-09-21", "2026-09-25"), ("три дня назад", "2026-09-27", "2026-09-27"), ("29-го сентября", "2026-09-29", "2026-09-29"), ("29.09", "2026-09-29", "2026-09-29"), ("на выходных", "2026-09-26", "2026-09-27"), ("31.02.2025", None, None), ("о чем говорили", None, None), ("на этой неделе", "2026-09-28", "2026-09-30"), ("29 февраля", None, None)]


def test_date_hints(spark):
    q = spark.createDataFrame([(k, t, dt.date(2026, 9, 30)) for k, (t, _, _) in enumerate(DATES)], "qid long, text string, today date")
    rows = dates.resolve_date_hints(q).orderBy("qid").collect()
    assert [(r.text, r.from_day and str(r.from_day), r.to_day and str(r.to_day)) for r in rows] == DATES


def test_contexts(spark):
    q = spark.createDataFrame([(1, "что я обещал?", dt.date(2026, 9, 30)), (2, "пусто", dt.date(2026, 9, 30))], "qid long, text string, today date")
    hit = lambda n, day, h, rank, text: (1, rank, n, day, at(h, 0), at(h, 5), "TRANSCRIPT", text)
    schema = "qid long, rank int, id long, day string, start_ms long, end_ms long, kind string, text string"
    two = spark.createDataFrame([hit(2, "2026-09-29", 15, 1, "второй"), hit(1, "2026-09-28", 10, 2, "первый")], schema)
    a, b = context.build_contexts(q, two, 1000, MSK).orderBy("qid").collect()
    assert [s.chunk_id for s in a.sources] == [1, 2] and "[1] (понедельник, 28 сентября 2026, 10:00–10:05, расшифровка)\nпервый" in a.user_prompt
    assert "(ничего не найдено)" in b.user_prompt and b.sources == []
    ten = spark.createDataFrame([hit(k, "2026-09-29", k, k, " ".join(["слово"] * 80)) for k in range(10)], schema)
    many = context.build_contexts(q.limit(1), ten, 400, MSK).first()
    assert 3 <= len(many.sources) <= 4


def test_planner(spark):
    utc = int(dt.datetime(2026, 9, 29, tzinfo=dt.timezone.utc).timestamp() * 1000)
    t = lambda h, m, extra=0: ("o", "2026-09-29", utc + (h * 60 + m) * 60_000, utc + (h * 60 + m + 2) * 60_000 + extra)
    rows = [t(9, 5), t(9, 40), t(10, 10), t(11, 2)]
    frame = lambda r: spark.createDataFrame(r, "owner_id string, day string, start_ms long, created_ms long")
    none = spark.createDataFrame([], "owner_id string, day string, period_start_ms long, source_count long, source_max_created_ms long")
    plan = lambda r, s, now, manual=False: {(x.level, x.period_start_ms) for x in summaries.plan_summaries(frame(r), s, now, manual, "UTC").collect() if x.todo}
    hour = lambda h: ("HOUR", utc + h * 3_600_000)
    assert plan(rows, none, utc + 11 * 3_600_000 + 1) == {hour(9), hour(10)}
    assert plan(rows, none, utc + 11 * 3_600_000 + 1, True) == {hour(9), hour(10), hour(11), ("DAY", 0)}
    stored = [("o", "2026-09-29", utc + h * 3_600_000, n, max(x[3] for x in rows if x[2] // 3_600_000 == (utc // 3_600_000 + h))) for h, n in ((9, 2), (10, 1), (11, 1))] + [("o", "2026-09-29", 0, 4, max(x[3] for x in rows))]
    fresh = spark.createDataFrame(stored, none.schema)
    later = utc + 30 * 3_600_000
    assert plan(rows, fresh, later) == set()
    assert plan([*rows, t(9, 50, 30 * 3_600_000)], fresh, later) == {hour(9), ("DAY", 0)}


def test_every_cut_of_a_digest_is_mended(spark):
    whole = json.dumps({"summary": "Встреча с «Сашей»", "events": ["обед", "об\"ед"], "agreements": [], "tasks": ["т1"], "ideas": [], "mood": "ок"}, ensure_ascii=False)
    cuts = spark.createDataFrame([(k, whole[:k]) for k in range(len(whole) + 1)] + [(1000, "нет объекта"), (1001, "x " + whole + " y"), (1002, None)], "k int, json string")
    rows = {r.k: r for r in digests.repair_digests(digests.parse_digests(cuts)).collect()}
    assert rows[len(whole)].digest.events == ["обед", 'об"ед'] and rows[1001].digest.mood == "ок"
    assert rows[1000].digest is None and rows[1002].digest is None and rows[0].digest is None
    usable = [k for k in range(len(whole)) if rows[k].digest is not None]
    assert usable and set(range(min(usable), len(whole))) <= set(usable)
    cut = whole.index("обед") + 2
    assert rows[cut].digest.events == ["об…"]


def test_summaries_map_and_reduce(spark):
    keys = ["owner_id", "day", "period_start_ms"]
    lines = spark.createDataFrame([("o", "2026-09-29", at(10, 0), at(10, k), k, f"[10:{k:02d}] " + " ".join(f"w{k}_{j}" for j in range(10))) for k in range(30)], "owner_id string, day string, period_start_ms long, start_ms long, id long, line string")
    packs = summaries.pack_lines(lines, keys, ["start_ms", "id"], "line", 100)
    assert packs.select("pack_no").distinct().count() == 4
    assert sorted(r.text for r in packs.collect()) == sorted(r.line for r in lines.collect())
    hours = summarize.summarize_hours(lines, models.first_words_llm, 100, F.lit("10:00")).collect()
    assert len(hours) == 1 and hours[0].digest.summary.startswith("Период: 10:00")
    with pytest.raises(ValueError):
        items = spark.createDataFrame([("o", k, "l", " ".join(["x"] * 50)) for k in range(4)], "owner_id string, n long, label string, text string")
        summarize.reduce_digests(items, ["owner_id"], models.first_words_llm, 40, False).collect()
    one = summaries.pack_lines(spark.createDataFrame([("o", 1, " ".join(["слово"] * 25))], "k string, n long, t string"), ["k"], ["n"], "t", 11)
    assert [len(r.text.split()) for r in one.orderBy("pack_no", "line_no").collect()] == [10, 10, 5]


def test_fallback_day(spark):
    d = "struct<summary: string, events: array<string>, agreements: array<string>, tasks: array<string>, ideas: array<string>, mood: string>"
    rows = [("o", "d", 1, "10:00, x", ("утро", ["a", "b"], [], [], [], "")), ("o", "d", 2, "11:00, x", ("", [], [], [], [], "скука")), ("o", "d", 3, "12:00, x", ("обед", ["b", "c"], [], [], [], "ок"))]
    r = summaries.fallback_day(spark.createDataFrame(rows, f"owner_id string, day string, period_start_ms long, label string, digest {d}")).first().digest
    assert (r.summary, r.events, r.mood) == ("10:00: утро 12:00: обед", ["a", "b", "c"], "ок")


def test_artifacts_and_reports(spark):
    catalog = spark.createDataFrame([(1, "vad", "ab12", "vad.onnx"), (2, "asr", None, "asr.tar.bz2")], "ord int, id string, sha256 string, name string")
    files = spark.createDataFrame([("a", "AB12", "x"), ("b", "00", "asr.tar.bz2"), ("c", "00", "y")], "path string, sha256 string, name string")
    assert {(r.path, r.entry) for r in logs.identify_artifacts(files, catalog).collect()} == {("a", "vad"), ("b", "asr"), ("c", None)}
    res = spark.createDataFrame([("один", 400, 50), (" ", 0, 50), (None, 10, 5), ("три", 0, 50)], "text string, duration_ms long, took_ms long")
    r = transcription.run_report(res).first()
    assert (r.processed, r.empty, r.undecryptable, r.rtf) == (3, 1, 1, 0.375)


def test_write_day_and_append(spark, tmp_path):
    schema = "owner_id string, id long, start_ms long, end_ms long, day string, text string, model string, lang string, created_ms long"
    rows = spark.createDataFrame([("o", k, k, k + 1, f"2026-09-{28 + k % 2}", f"t{k}", "m", "", 1) for k in range(6)], schema)
    path = str(tmp_path)
    diary.append_transcripts(rows, path, 0)
    diary.append_transcripts(rows, path, 1)
    assert spark.read.parquet(f"{path}/transcripts").count() == 6
    diary.write_day(rows.filter("day = '2026-09-28'").limit(1), path, "transcripts")
    after = spark.read.parquet(f"{path}/transcripts").groupBy(F.col("day").cast("string").alias("day")).count().collect()
    assert {r["day"]: r["count"] for r in after} == {"2026-09-28": 1, "2026-09-29": 3}


def test_dst_hours_stay_apart(spark):
    base = int(dt.datetime(2026, 10, 25, 0, 30, tzinfo=dt.timezone.utc).timestamp() * 1000)
    r = spark.createDataFrame([(base,), (base + 3_600_000,)], "ms long").select(timeutil.hour_start(F.col("ms"), "Europe/Berlin").alias("h")).collect()
    assert r[0].h != r[1].h


def test_all_rows_of_one_owner(spark):
    rows = spark.createDataFrame([("hot", "2026-09-29", k, at(0, 0) + k * 20_000, at(0, 0) + k * 20_000 + 9000, "слово дело тело") for k in range(3000)], "owner_id string, day string, id long, start_ms long, end_ms long, text string")
    got = chunks.chunk_transcripts(rows, MSK).collect()
    assert sum(len(r.text.split("\n")) for r in got) == 3000


def test_vector_search_asks_every_fiftieth_row(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vector_index, "QUESTIONS", 4)  # so that the questions go in several blocks
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    scale = (np.abs(v).max(1).astype(np.float64) / 127).astype(np.float32)[:, None]
    q = np.clip(np.floor((v / scale).astype(np.float64) + 0.5), -127, 127)
    chunk = np.flatnonzero(ids % 17 != 0)
    expected = set()
    for k in np.flatnonzero(ids % 50 == 0):
        score = np.round(q[chunk] @ v[k].astype(np.float64) * scale[chunk, 0].astype(np.float64), 6)
        expected |= {(int(ids[k]), int(ids[chunk[c]]), rank) for rank, c in enumerate(np.lexsort((ids[chunk], -score))[:30], 1)}
    assert {(r.qid, r.chunk_id, r["rank"]) for r in registry.vector_search(spark, sf_dir).collect()} == expected


def test_fuse_rrf_takes_all_users(spark, tmp_path):
    events = [(k, 150 + k * 7 % 120, float(k * 13 % 90)) for k in range(900)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    lists = {}
    for k, user, value in events:
        seen = lists.setdefault((user, k % 3), [])
        if int(value) % 50 not in seen:
            seen.append(int(value) % 50)
    expected = {}
    for (user, _), seen in lists.items():
        for rank, i in enumerate(seen, 1):
            expected[user, i] = expected.get((user, i), 0) + 1 / (60 + rank)
    got = {(r.qid, r.id): r.score for r in registry.fuse_rrf(spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(s, abs=1e-8) for k, s in expected.items()} and max(got)[0] > 200


def test_transcription_queries_keep_whole_texts(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    whole = {r.conv_id * 100 + r.turn: r.text.strip() for r in turns}
    assert max(map(len, whole.values())) > 40
    assert {r.id: r.text for r in registry.transcribe(spark, sf_dir).collect()} == whole
    assert sorted(r.text for r in registry.to_transcripts(spark, sf_dir).collect()) == sorted(t for k, t in whole.items() if k % 5)
