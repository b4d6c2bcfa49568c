"""Packing, reducing, appending and alarms against plain versions of themselves."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybook.functions import models
from daybook.operators import buffer, digests, summaries, telemetry
from daybook.plans import summarize
from daybook.sources import diary
from daybook.streaming import jobs

# ---- packing


def packed_plain(lines, budget):
    packs, used = [], 0
    for line in lines:
        for piece in summaries._pieces(line or "", budget, summaries.count_words):
            cost = len(piece.split()) + 1
            if not packs or used + cost > budget:
                packs.append([])
                used = 0
            packs[-1].append(piece)
            used += cost
    return [(k, n, p) for k, pack in enumerate(packs) for n, p in enumerate(pack)]


@pytest.mark.parametrize("budget", [1, 7, 40, 1000])
def test_packs_equal_the_sequential_packer(spark, budget):
    rng = random.Random(budget)
    line = lambda: rng.choice([None, "", "word", " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 3, 10, 60])))])
    keys = [("o", 1), ("o", 2), ("p", None), (None, 3)]
    lines = {k: [line() for _ in range(rng.choice([1, 30, 200]))] for k in keys}
    rows = [(*k, n, t) for k, ts in lines.items() for n, t in enumerate(ts)]
    rng.shuffle(rows)
    got = summaries.pack_lines(spark.createDataFrame(rows, "owner_id string, part int, n long, line string"), ["owner_id", "part"], ["n"], "line", budget)
    found = {k: [] for k in keys}
    for r in got.collect():
        found[r.owner_id, r.part].append((r.pack_no, r.line_no, r.text))
    assert {k: sorted(v) for k, v in found.items()} == {k: packed_plain(ts, budget) for k, ts in lines.items()}


def test_a_key_of_a_million_lines(spark):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.col("id") % 9 + 1), lambda k: F.lit("w")), " ")
    packs = summaries.pack_lines(spark.range(1_000_000).select(F.lit("k").alias("key"), "id", words.alias("line")), ["key"], ["id"], "line", 100)
    assert "FlatMapGroups" not in packs._jdf.queryExecution().toString()
    cost = F.size(F.split("text", " ")) + 1
    per = packs.groupBy("pack_no").agg(F.sum(cost).alias("used"), F.count("*").alias("n"), F.min_by(cost, "line_no").alias("first"))
    n, full, lines = per.agg(F.count("*"), F.max("used"), F.sum("n")).first()
    assert lines == 1_000_000 and full <= 100 and n == per.agg(F.max("pack_no") + 1).first()[0]
    # no pack would have taken the next one's first line
    after = per.select((F.col("pack_no") - 1).alias("pack_no"), F.col("first").alias("more"))
    assert per.join(after, "pack_no").filter("used + more <= 100").isEmpty()


# ---- reducing


def said(prompt, tokens):
    text = models.first_words_llm(pd.DataFrame([{"system": summaries.SYSTEM, "prompt": prompt, "max_tokens": tokens, "temperature": 0.0}])).iloc[0]
    d = json.loads(text[text.index("{") : text.rindex("}") + 1])
    return {k: v.strip() if isinstance(v, str) else list(dict.fromkeys(x.strip() for x in v if x.strip())) for k, v in d.items()}


def written(d):
    return json.dumps({k: d[k] for k in ("summary", "events", "agreements", "tasks", "ideas", "mood")}, ensure_ascii=False, separators=(",", ":"))


def reduced_plain(texts, label, budget, day):
    while True:
        packs = {}
        for k, _, p in packed_plain(texts, budget):
            packs.setdefault(k, []).append(p)
        if len(packs) > 1 and len(packs) >= len(texts):
            raise ValueError("does not converge")
        last = len(packs) == 1
        made = []
        for k, parts in packs.items():
            whole = day and last
            head = f"{'День' if whole else 'Период'}: {label if last else f'{label}, группа {k + 1}'}. {summaries.MERGE_DAY if whole else summaries.MERGE_PARTS}"
            made.append(said("\n".join([head, *parts, "", summaries.FIELDS]), summaries.DAY_TOKENS if whole else summaries.HOUR_TOKENS))
        if last:
            return made[0]
        texts = [f"Группа {k + 1}: {written(d)}" for k, d in enumerate(made)]


@pytest.mark.parametrize("day", [False, True])
def test_reduced_digests_equal_the_plain_reduction(spark, day):
    rng = random.Random(6)
    items = {f"o{k}": [" ".join(f"слово{rng.randint(0, 50)}" for _ in range(rng.randint(1, 25))) for _ in range(n)] for k, n in enumerate((1, 2, 9, 40, 150))}
    rows = [(o, n, f"метка {o}", t) for o, ts in items.items() for n, t in enumerate(ts)]
    got = summarize.reduce_digests(spark.createDataFrame(rows, "owner_id string, n long, label string, text string"), ["owner_id"], models.first_words_llm, 120, day)
    assert {r.owner_id: r.digest.asDict() for r in got.collect()} == {o: reduced_plain(ts, f"метка {o}", 120, day) for o, ts in items.items()}


def test_days_equal_the_plain_reduction(spark):
    rng = random.Random(8)
    hour = 3_600_000
    rows = []
    for o in ("a", "b"):
        for h in range(14):
            empty = h % 5 == 0
            d = {"summary": "" if empty else f"час {h} владельца {o}", "events": [] if empty else [f"e{rng.randint(0, 9)}" for _ in range(rng.randint(0, 20))], "agreements": [], "tasks": [], "ideas": [], "mood": "ровно"}
            rows.append((o, "2026-09-29", 1_790_640_000_000 + h * hour, json.dumps(d, ensure_ascii=False)))
    hours = digests.parse_digests(spark.createDataFrame(rows, "owner_id string, day string, period_start_ms long, json string")).select("owner_id", "day", "period_start_ms", "digest")
    labelled = hours.withColumn("label", summarize.hour_label(F.col("day"), F.col("period_start_ms"), "UTC")).orderBy("period_start_ms").collect()
    expected = {}
    for o in ("a", "b"):
        texts = [f"{r.label}: {written(r.digest.asDict())}" for r in labelled if r.owner_id == o and (r.digest.summary or r.digest.events)]
        expected[o] = reduced_plain(texts, "2026-09-29", 100, True)
    got = {r.owner_id: r.digest.asDict() for r in summarize.summarize_days(hours, models.first_words_llm, 100, "UTC").collect()}
    assert got == expected


@pytest.fixture()
def several_tasks(spark):
    """Small shuffles are read by several tasks too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def joined_lines(spark):
    """Lines of four keys from a join by the key whose other side turns out to be small only when it runs."""
    todo = spark.range(2_000_000).filter("id < 4").groupBy(F.col("id").alias("k")).count().select("k")
    lines = spark.range(0, 4_000_000, 1, 4).filter("id % 40000 < 4").select((F.col("id") % 4).alias("k"), F.col("id").alias("n"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("line"))
    return lines.join(todo, "k", "left_semi")


def test_lines_of_a_key_meet_in_one_task_after_a_join(spark, several_tasks):
    got = summaries.pack_lines(joined_lines(spark), ["k"], ["n"], "line", 150).collect()
    expected = [(k, *row) for k in range(4) for row in packed_plain([f"l{n}" for n in range(k, 4_000_000, 40_000)], 150)]
    assert sorted(tuple(r) for r in got) == expected


def test_prompts_of_a_key_after_a_join(spark, several_tasks):
    packs = summaries.pack_lines(joined_lines(spark), ["k"], ["n"], "line", 150)
    got = summaries.map_prompts(packs, ["k"], F.lit("day")).collect()
    assert sorted((r.k, r.pack_no, r.n_packs) for r in got) == [(k, n, 2) for k in range(4) for n in range(2)]
    first = next(r.prompt for r in got if (r.k, r.pack_no) == (1, 0))
    assert first.startswith("Период: day, часть 1 из 2.") and [x for x in first.split("\n") if x.startswith("l")] == [f"l{n}" for n in range(1, 75 * 40_000, 40_000)]


def test_each_pack_is_one_request_after_a_join(spark, several_tasks):
    packs = summaries.pack_lines(joined_lines(spark), ["k"], ["n"], "line", 150)
    raw = summaries.complete(summaries.map_prompts(packs, ["k"], F.lit("day")), lambda r: r["prompt"].map(lambda p: str(sum(x.startswith("l") for x in p.split("\n")))))
    assert sorted((r.k, r.raw) for r in raw.collect()) == [(k, n) for k in range(4) for n in ("25", "75")]


# ---- appending

SCHEMA = "owner_id string, id long, start_ms long, end_ms long, day string, text string, model string, lang string, created_ms long"


def told(spark, ids, created=1_000_000):
    return spark.createDataFrame([("o", k, k * 1000, k * 1000 + 1, f"2026-09-{k % 3 + 10}", f"t{k}" if k % 7 else " ", "m", "", created + k) for k in ids], SCHEMA)


def kept(spark, path):
    return sorted(r.id for r in diary.read_table(spark, path, "transcripts").collect())


def test_a_batch_that_was_cut_off_is_made_good(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    diary.append_transcripts(told(spark, range(0, 10)), path, 0, "s", False)
    real = diary.Ledger.tell

    def cut_off(self, batch_id, what):
        if what == "done":
            raise RuntimeError("the driver is gone")
        real(self, batch_id, what)

    monkeypatch.setattr(diary.Ledger, "tell", cut_off)
    with pytest.raises(RuntimeError):
        diary.append_transcripts(told(spark, range(10, 20)), path, 1, "s", False)  # the rows are there, the ledger says nothing of it
    monkeypatch.setattr(diary.Ledger, "tell", real)
    for _ in range(2):
        diary.append_transcripts(told(spark, range(10, 20)), path, 1, "s", False)
        assert kept(spark, path) == [k for k in range(20) if k % 7]
    diary.append_transcripts(told(spark, range(0, 10)), path, 0, "s", False)
    # another stream's batches have numbers of their own; without a number rows are always compared, and with one where repeats may be
    diary.append_transcripts(told(spark, range(20, 25)), path, 0, "other", False)
    diary.append_transcripts(told(spark, range(15, 30)), path)
    diary.append_transcripts(told(spark, range(15, 30)), path, 7, "other")
    assert kept(spark, path) == [k for k in range(30) if k % 7]


def test_a_new_batch_is_appended_without_reading_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    monkeypatch.setattr(diary, "exists", lambda *a: pytest.fail("the table was looked for"))
    diary.append_transcripts(told(spark, range(5)), path, 0, repeats=False)
    diary.append_transcripts(told(spark, range(5, 9)), path, 1, repeats=False)
    assert len(kept(spark, path)) == 7


def test_a_stream_drops_what_is_told_again(spark, tmp_path):
    source, path, log = (str(tmp_path / x) for x in ("in", "diary", "log"))
    told(spark, range(0, 30)).coalesce(1).write.mode("append").parquet(source)
    told(spark, range(20, 50), 1_000_500).coalesce(1).write.mode("append").parquet(source)
    run = lambda: jobs.append_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), path, log).awaitTermination()
    run()
    told(spark, range(40, 60), 1_001_000).coalesce(1).write.mode("append").parquet(source)
    run()
    assert kept(spark, path) == [k for k in range(60) if k % 7]


def at_one_moment(spark):
    """Two segments that begin together, the first of them told twice."""
    rows = told(spark, [1, 2]).withColumn("start_ms", F.lit(1000).cast("long"))
    return rows.unionByName(rows.filter("id = 1"))


def test_segments_that_begin_together_are_both_appended(spark, tmp_path):
    path, rows = str(tmp_path), at_one_moment(spark)
    assert sorted(r.id for r in diary.new_transcripts(rows.limit(0), rows).collect()) == [1, 2]
    assert [r.id for r in diary.new_transcripts(rows.filter("id = 1"), rows).collect()] == [2]
    for _ in range(2):
        diary.append_transcripts(rows, path)
        assert kept(spark, path) == [1, 2]


def test_a_stream_appends_segments_that_begin_together(spark, tmp_path):
    source, path, log = (str(tmp_path / x) for x in ("in", "diary", "log"))
    at_one_moment(spark).coalesce(1).write.parquet(source)
    jobs.append_stream(spark.readStream.schema(SCHEMA).parquet(source), path, log).awaitTermination()
    assert kept(spark, path) == [1, 2]


# ---- retention


@pytest.mark.parametrize("most", [0, 50, 4000, 10**9])
def test_rows_are_kept_alike_with_and_without_blocks(spark, most):
    rng = random.Random(most)
    rows = [(o, n, rng.randint(0, 40), rng.randint(1, 100)) for o, many in (("a", 300), ("b", 1), ("c", 60)) for n in range(many)]
    df = spark.createDataFrame(rows, "owner_id string, id long, at long, size long")
    order = [F.desc("at"), "id"]
    expected = set()
    for o in "abc":
        total = 0
        for k, r in enumerate(sorted((r for r in rows if r[0] == o), key=lambda r: (-r[2], r[1]))):
            total += r[3]
            if total <= most or k == 0:
                expected.add(r)
    for block in (None, F.floor(F.col("at") / 7), F.col("at")):
        kept, dropped = buffer.retain_by_size(df, ["owner_id"], order, "size", most, block)
        assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == expected
        assert {tuple(r) for r in dropped.collect()} == set(rows) - expected


# ---- silence

FRAMES = "owner_id string, frame_no long, frame_start_ms long, dbfs double, silenced boolean, n_samples int"


def levels(rng, owner, start, n):
    rows, at, quiet = [], start, False
    for k in range(n):
        if rng.random() < 0.02:
            quiet = not quiet
        rows.append((owner, k, at, -96.0 if quiet and k % 3 else -40.0, quiet and k % 3 == 0, 512))
        at += 32
    return rows


def silence_plain(rows, min_ms):
    out, run = [], None
    for owner, _, ms, db, shut, n in sorted(rows, key=lambda r: (r[0], r[2])):
        if run and (run[0] != owner or not (shut or db <= -96)):
            out.append((*run, run[2] - run[1] > min_ms))
            run = None
        if shut or db <= -96:
            run = [owner, run[1] if run else ms, ms + n // 16, run[3] + 1 if run else 1]
    return sorted([*out, *([(*run, run[2] - run[1] > min_ms)] if run else [])])


def test_silence_across_hours_and_in_a_stream(spark, tmp_path):
    rng = random.Random(12)
    hour = 3_600_000
    rows = levels(rng, "a", 5 * hour - 20_000, 3000) + levels(rng, "b", 7 * hour - 40_000, 2500)
    rows += [("c", k, 9 * hour - 5000 + 32 * k, -96.0, False, 512) for k in range(400)]  # one run on both sides of the hour
    expected = silence_plain(rows, 1000)
    df = spark.createDataFrame(rows, FRAMES)
    assert sorted(tuple(r) for r in telemetry.silence_runs(df, 1000).collect()) == expected
    assert len({x[0] for x in expected}) == 3 and {x[4] for x in expected} == {True, False}
    source = str(tmp_path / "in")
    for lo, hi in ((0, 6 * hour), (6 * hour, 8 * hour), (8 * hour, 9 * hour), (9 * hour, 99 * hour)):
        df.filter(f"frame_start_ms >= {lo} AND frame_start_ms < {hi}").coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("z", 0, 200 * hour, -96.0, False, 512)], FRAMES).write.mode("append").parquet(source)
    stream = jobs.silence_runs_stream(spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(source), 1000)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == expected
