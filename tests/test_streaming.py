"""The streaming segmenter: restarts from its checkpoint, frames within the delay in any order, state by second."""

import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import segmentation
from daybook.streaming import jobs

SCHEMA = "owner_id string, frame_start_ms long, prob double, n_samples int"


def frames(spark, rng, owners, start):
    rows = []
    for o in owners:
        at = start + rng.randint(0, 3000)
        for _ in range(12):
            p, n = rng.choice([0.1, 0.4, 0.9]), rng.choice([5, 30, 60, 300, 900])
            rows += [(o, at + 32 * k, p, 512) for k in range(n)]
            at += 32 * n
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, source, sink, log):
    stream = jobs.segment_speech_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def add(df, source, lo, hi):
    df.filter((F.col("frame_start_ms") >= lo) & (F.col("frame_start_ms") < hi)).coalesce(1).write.mode("append").parquet(source)


@pytest.fixture()
def places(spark, tmp_path):
    jobs.rocksdb_state(spark)
    return [str(tmp_path / x) for x in ("in", "out", "log")]


def clock(spark, source, ms):
    spark.createDataFrame([("clock", ms, 0.0, 0)], SCHEMA).write.mode("append").parquet(source)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_stream_goes_on_from_its_checkpoint(spark, places):
    source, sink, log = places
    df = frames(spark, random.Random(4), "abc", 1_000_000).cache()
    last = df.agg(F.max("frame_start_ms")).first()[0]
    cuts = [0, 1_000_000 + 20_000, 1_000_000 + 45_000, last + 1]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        add(df, source, lo, hi)
        run(spark, source, sink, log)  # a new query each time, in the middle of speech
    before = spark.read.parquet(sink).count()
    clock(spark, source, last + 10_000_000)
    query = run(spark, source, sink, log)
    got = spark.read.parquet(sink)
    assert 0 < before < got.count()
    assert rows(got) == rows(segmentation.segment_speech(df))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0  # nothing is left behind
    run(spark, source, sink, log)
    assert spark.read.parquet(sink).count() == got.count()


def test_frames_within_the_delay_may_come_in_any_order(spark, places):
    source, sink, log = places
    df = frames(spark, random.Random(9), "xy", 5_000_000).cache()
    last = df.agg(F.max("frame_start_ms")).first()[0]
    # every file has odd frames of its ten seconds and even ones of the four seconds before
    for lo in range(5_000_000, last + 10_000, 10_000):
        early = df.filter(F.expr(f"frame_start_ms >= {lo} AND frame_start_ms < {lo + 10_000} AND (pmod(floor(frame_start_ms / 32), 2) = 1 OR frame_start_ms < {lo + 6000})"))
        late = df.filter(F.expr(f"frame_start_ms >= {lo - 4000} AND frame_start_ms < {lo} AND pmod(floor(frame_start_ms / 32), 2) = 0"))
        early.unionByName(late).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(source)
    clock(spark, source, last + 10_000_000)
    run(spark, source, sink, log)
    assert rows(spark.read.parquet(sink)) == rows(segmentation.segment_speech(df))


def test_state_is_kept_by_second(spark, places):
    source, sink, log = places
    df = spark.createDataFrame([("a", 1_000_000 + 32 * k, 0.9, 512) for k in range(1000)], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(source)
    query = run(spark, source, sink, log)
    # ten seconds of frames wait for the watermark; what was stepped through is one value
    total = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 40 and total <= 80
    # after a minute without frames what is open is closed, long before any other owner's end
    clock(spark, source, 1_000_000 + 32_000 + 75_000)
    run(spark, source, sink, log)
    assert [(r.start_ms, r.n_frames, r.split_by_max) for r in spark.read.parquet(sink).orderBy("start_ms").collect()] == [(1_000_000, 875, True), (1_028_000, 125, False)]


def test_frames_reach_the_state_packed_by_second(spark, places):
    source, sink, log = places
    rng = random.Random(3)
    wrong = [(o, 2_000_000 + 700 * k, 0.9, 160) for o in ("a", None) for k in range(40)]
    right = [(o, 2_000_000 + 32 * k, rng.choice([0.1, 0.4, 0.9, None]), 512) for o in ("a", "b", None) for k in range(9000)]
    told = spark.createDataFrame(rng.sample(right + wrong, len(right + wrong)), SCHEMA).coalesce(1)
    packed = jobs._packed(told, segmentation.SegmenterConfig()).collect()
    assert len(packed) < 5 * 3 * 288  # an owner's second is a row of an Arrow batch, of which there are three
    seen = []
    for r in packed:
        ms = [int.from_bytes(r.ms[k : k + 8], "little") for k in range(0, len(r.ms), 8)]
        assert len({x // 1000 for x in [*ms, r.last_ms]}) == 1 and max([*ms, r.last_ms]) == r.last_ms
        seen += [(r.owner_id, x, k) for x, k in zip(ms, r.kinds, strict=True)]
    kind = lambda p: 1 if p is None else 2 if p >= 0.5 else 0 if p < 0.35 else 1
    assert sorted(seen, key=str) == sorted(((o, ms, kind(p)) for o, ms, p, _ in right), key=str)
    # five minutes of three owners wait in the state as a few blocks
    told.filter("owner_id IS NOT NULL").write.parquet(source)
    query = run(spark, source, sink, log)
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 30
