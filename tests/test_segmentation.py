"""The composed segmenter against the sequential machine: stretches of any length, owners that are never quiet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.operators import segmentation
from daybook.operators.segmentation import FRAME_MS, Machine, SegmenterConfig, States

CFG = SegmenterConfig()


def runs_of(spec, start=0):
    """(kind, first_ms, n) of runs (kind, n, gap in ms after it)."""
    at, out = start, []
    for kind, n, gap in spec:
        out.append((kind, at, n))
        at += n * FRAME_MS + gap
    return out


def sequential(runs, cfg=CFG):
    machine, out, last = Machine(cfg), [], 0
    for kind, first, n in runs:
        out += machine.feed(kind, first, n)
        last = first + (n - 1) * FRAME_MS
    return sorted([*out, *machine.flush(last)])


def never_quiet(rng, n):
    """Runs in which less than 53 frames in a row are quiet."""
    spec, before = [], -1
    for _ in range(n):
        kind = rng.choice([k for k in (0, 1, 2) if k != before])
        before = kind
        spec.append((kind, rng.choice([1, 5, 21, 22, 30, 52]) if kind == 0 else rng.choice([1, 5, 13, 100, 874, 875, 900, 2000]), rng.choice([0, 0, 0, 7, 5000])))
    return spec


def mixed(rng, n):
    return [(rng.choice([0, 0, 1, 2]), rng.choice([1, 3, 10, 22, 43, 53, 60, 300]), rng.choice([0, 0, 40])) for _ in range(n)]


def frames(spark, owners):
    rows = [(o, first + k * FRAME_MS, (0.1, 0.4, 0.9)[kind], 512) for o, runs in owners.items() for kind, first, n in runs for k in range(n)]
    return spark.createDataFrame(rows, "owner_id string, frame_start_ms long, prob double, n_samples int")


@pytest.mark.parametrize("cfg", [CFG, SegmenterConfig(pre_roll_ms=64, silence_ms=160, tail_ms=64, longest_ms=640, shortest_ms=96), SegmenterConfig(pre_roll_ms=32, silence_ms=32, tail_ms=0, longest_ms=320)])
def test_transition_equals_the_machine_from_every_state(cfg):
    rng, states = random.Random(7), States(cfg)
    for _ in range(6):
        spec = (never_quiet if rng.random() < 0.5 else mixed)(rng, rng.randint(1, 14))
        after = states.transition([(kind, n) for kind, n, _ in spec])
        for k in rng.sample(range(states.n), min(states.n, 120)):
            machine = states.machine(cfg, k)
            for kind, first, n in runs_of(spec):
                list(machine.feed(kind, first, n))
            assert after[k] == states.number(machine.inside, len(machine.before), machine.size, machine.quiet)


@pytest.mark.parametrize("stretch_ms", [320, 3200, 60_000, 3_600_000])
def test_composed_stretches_equal_the_sequential_machine(spark, stretch_ms):
    rng = random.Random(stretch_ms)
    owners = {f"n{k}": runs_of(never_quiet(rng, 8 if stretch_ms < 1000 else 20), k * 12_345) for k in range(4)} | {f"m{k}": runs_of(mixed(rng, 40), k * 777) for k in range(6)}
    got = segmentation.segment_speech(frames(spark, owners), stretch_ms=stretch_ms).collect()
    for owner, runs in owners.items():
        assert sorted((r.start_ms, r.n_frames, r.speech_ms, r.split_by_max, r.close_ms, r.dropped) for r in got if r.owner_id == owner) == sequential(runs), owner


def test_an_owner_of_all_frames_is_never_in_one_task(spark):
    # forty hours of speech without a pause, 53 quiet frames are never in a row
    minute = [(2, 700, 0), (0, 21, 0), (1, 300, 0), (0, 40, 0), (2, 814, 0)]
    runs = runs_of(minute * 60 * 40)
    rows = spark.createDataFrame([(k, first, n) for k, first, n in runs], "kind int, first long, n int").repartition(4)
    prob = F.when(F.col("kind") == 0, 0.1).when(F.col("kind") == 1, 0.4).otherwise(0.9)
    df = rows.select(F.lit("hot").alias("owner_id"), prob.alias("prob"), F.lit(512).alias("n_samples"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.col("first") + k * FRAME_MS)).alias("frame_start_ms"))
    stretches = segmentation.stretches_of(df, CFG)
    sizes = [r.n for r in stretches.select(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("n")).collect()]
    assert len(sizes) >= 40 and max(sizes) <= 3_600_000 // FRAME_MS
    left = segmentation.transitions(stretches.withColumn("is_first", F.col("stretch") == 0), CFG)
    assert left.filter("settled").count() == 1  # nothing but the first stretch settles the state
    got = segmentation.segment_speech(df).collect()
    assert sorted((r.start_ms, r.n_frames, r.speech_ms, r.split_by_max, r.close_ms, r.dropped) for r in got) == sequential(runs)


def test_no_frames(spark):
    none = frames(spark, {"o": runs_of([(2, 3, 0)])})
    assert segmentation.segment_speech(none.limit(0)).count() == 0
    assert segmentation.segment_speech(none.withColumn("n_samples", F.lit(256))).count() == 0
    assert np.array_equal(States(CFG).transition([]), np.arange(States(CFG).n))
