"""The chunk store and the day counts: whole states only, changed days alone, and the same as a full scan after any batches."""

import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import chunks, summaries
from daybook.plans.index import sync_index
from daybook.sources import chunk_store, day_counts
from daybook.sources.chunk_store import ChunkStore

DRAFT = "owner_id string, day string, kind string, start_ms long, end_ms long, text string, ord long"
DAYS = ["2026-09-28", "2026-09-29", "2026-09-30"]


def drafts(spark, texts):
    """texts: {(owner, day): texts}"""
    rows = [(o, d, "TRANSCRIPT", k, k + 1, t, k) for (o, d), ts in texts.items() for k, t in enumerate(ts)]
    return chunks.hash_chunks(spark.createDataFrame(rows, DRAFT))


def changed(spark, keys, signature="s"):
    return spark.createDataFrame([(o, d, signature) for o, d in keys], "owner_id string, day string, signature string")


def days_of(spark, keys):
    return spark.createDataFrame(list(keys), "owner_id string, day string")


def state(store):
    return {(r.owner_id, r.day, r.text) for r in store.chunks().collect()}, {(r.owner_id, r.day, r.signature, r.chunks) for r in store.index_days().collect()}


@pytest.fixture()
def store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "index"))
    assert store.version() == -1 and store.chunks().count() == 0 and store.index_days().count() == 0
    keys = [(o, d) for o in ("a", "b") for d in DAYS[:2]]
    report = sync_index(store, drafts(spark, {k: ["one", "two"] for k in keys}), changed(spark, keys), days_of(spark, keys), 5)
    assert {(r.owner_id, r.day, r.added, r.removed) for r in report.collect()} == {(*k, 2, 0) for k in keys}
    return store


def test_a_sync_writes_changed_days_alone(spark, store):
    keys = [(o, d) for o in ("a", "b") for d in DAYS[:2]]
    before = store.days()
    now = [("a", DAYS[1]), ("a", DAYS[2])]
    report = sync_index(store, drafts(spark, {now[0]: ["one", "three"], now[1]: ["new"]}), changed(spark, now, "t"), days_of(spark, [*keys, now[1]]), 6)
    assert {(r.owner_id, r.day, r.added, r.removed) for r in report.collect()} == {("a", DAYS[1], 1, 1), ("a", DAYS[2], 1, 0)}
    texts, marks = state(store)
    assert texts == {(o, d, t) for o, d in keys for t in ("one", "two")} - {("a", DAYS[1], "two")} | {("a", DAYS[1], "three"), ("a", DAYS[2], "new")}
    assert marks == {("a", DAYS[0], "s", 2), ("b", DAYS[0], "s", 2), ("b", DAYS[1], "s", 2), ("a", DAYS[1], "t", 2), ("a", DAYS[2], "t", 1)}
    after = store.days()
    assert after[DAYS[0]] == before[DAYS[0]] and after[DAYS[1]] != before[DAYS[1]] and set(after) == set(DAYS)
    # nothing changed: no commit
    assert sync_index(store, drafts(spark, {}), changed(spark, []), days_of(spark, [*keys, now[1]]), 7).count() == 0 and store.version() == 1


def test_days_without_sources_lose_their_chunks_and_vectors_stay(spark, store):
    kind = "struct<scale: float, q: array<tinyint>>"
    vector = F.struct(F.lit(1.0).cast("float").alias("scale"), F.array(F.lit(3).cast("tinyint")).alias("q")).cast(kind)
    store.commit(store.chunks().withColumn("vector", vector).withColumn("model", F.lit("m")), store.index_days(), list(store.days()))
    left = [("a", DAYS[0]), ("b", DAYS[1])]
    sync_index(store, drafts(spark, {left[0]: ["two", "four"]}), changed(spark, left[:1], "u"), days_of(spark, left), 8)
    rows = store.chunks().collect()
    assert {(r.owner_id, r.day, r.text, r.vector is not None) for r in rows} == {("a", DAYS[0], "two", True), ("a", DAYS[0], "four", False), ("b", DAYS[1], "one", True), ("b", DAYS[1], "two", True)}
    sync_index(store, drafts(spark, {}), changed(spark, []), days_of(spark, []), 9)
    assert state(store) == (set(), set())


def test_a_commit_that_is_cut_off_changes_nothing(spark, store, monkeypatch):
    before, version = state(store), store.version()
    now = [("a", DAYS[0])]
    sync = lambda: sync_index(store, drafts(spark, {now[0]: ["other"]}), changed(spark, now, "x"), days_of(spark, [(o, d) for o in ("a", "b") for d in DAYS[:2]]), 6)
    with monkeypatch.context() as m:
        m.setattr(chunk_store.ChunkStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError, match="cut off"):
            sync()
    assert state(store) == before and store.version() == version
    gone = store.vacuum()
    assert len([g for g in gone if g.startswith("chunks/")]) == 1 and state(store) == before
    # of two commits from one state the second fails
    with monkeypatch.context() as m:
        m.setattr(chunk_store.ChunkStore, "version", lambda self: version - 1)
        with pytest.raises(RuntimeError, match="there already"):
            ChunkStore(spark, store.path)._publish(version, {})
    assert state(store) == before
    sync()
    assert ("a", DAYS[0], "other") in state(store)[0] and store.version() == version + 1
    reading = store.chunks()
    assert store.vacuum() and state(store)[0] and reading.count() == 7


# ---- day counts

SUMMARY = "owner_id string, day string, period_start_ms long, created_ms long"
SEGMENT = "owner_id string, day string, start_ms long, created_ms long"


def test_counts_equal_a_full_scan_after_random_batches(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "counts")
    none = spark.createDataFrame([], "owner_id string, day string, signature string")
    told, stored = {}, {}
    for k in range(5):
        batch = [(rng.choice("ab"), rng.choice(DAYS), rng.randint(0, 10**6), 1000 * k + rng.randint(0, 99)) for _ in range(rng.randint(0, 6))]
        told.update({(r[0], r[2]): r for r in batch})
        segments = spark.createDataFrame(list(told.values()), SEGMENT)
        for _ in range(2):  # a batch that is run again changes nothing
            day_counts.refresh_day_counts(segments, spark.createDataFrame(batch, SEGMENT), path, "transcripts")
        new = spark.createDataFrame([(rng.choice("ab"), rng.choice(DAYS), rng.choice([0, 3600]), 1000 * k + 500) for _ in range(3)], SUMMARY).dropDuplicates(["owner_id", "day", "period_start_ms"])
        old = spark.createDataFrame(list(stored.values()), SUMMARY)
        after = [tuple(r) for r in summaries.upsert_summaries(old, new).collect()]
        touched = new.unionByName(old.limit(0))
        if k == 3 and after:  # a day loses all its digests
            lost = after[0][1]
            touched = touched.unionByName(spark.createDataFrame([r for r in after if r[1] == lost], SUMMARY))
            after = [r for r in after if r[1] != lost]
        stored = {r: r for r in after}
        now = spark.createDataFrame(after, SUMMARY).select("owner_id", "day", "period_start_ms", "created_ms")
        day_counts.refresh_day_counts(now, touched, path, "summaries")
        found = day_counts.days_to_index(spark, path, none)
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in chunks.changed_days(segments, now, none).collect()}
    assert all("/counts/" in f for f in found.inputFiles())
    # what was indexed is no change
    assert day_counts.days_to_index(spark, path, found.select("owner_id", "day", "signature")).count() == 0
