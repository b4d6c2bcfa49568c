"""Speech segments from frame probabilities: hysteresis over runs of equal frames, in stretches whose effects are composed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.ordered import since_mark, with_previous
from daybook.sources.shared import cut

FRAME_MS = 32


@dataclass(frozen=True)
class SegmenterConfig:
    """Thresholds, and spans in milliseconds."""

    start: float = 0.5
    stop: float = 0.35
    pre_roll_ms: int = 320
    silence_ms: int = 700
    tail_ms: int = 200
    longest_ms: int = 28_000
    shortest_ms: int = 400

    @staticmethod
    def frames(ms: int) -> int:
        return -(-ms // FRAME_MS)

    @property
    def safe(self) -> int:
        """Quiet frames in a row after which the state can't depend on what was before: the silence may be cut once by the longest
        segment and start again, then the pre-roll fills."""
        return 2 * self.frames(self.silence_ms) - 1 + self.frames(self.pre_roll_ms)


#: Milliseconds of a stretch: what one task works on at once.
STRETCH_MS = 3_600_000
#: Stands for where the segment that is open at a stretch's start began; numbers above it for the starts of the frames before.
CARRIED = -(1 << 62)
LEFT = "owner_id string, stretch long, after array<int>, settled boolean, inside boolean, before array<long>, begin long, size long, speech long, quiet long, last_ms long"
ENTRY = "owner_id string, stretch long, inside boolean, before array<long>, begin long, size long, speech long, quiet long, is_last boolean"
SEGMENTS = "owner_id string, start_ms long, n_frames long, speech_ms long, split_by_max boolean, close_ms long, dropped boolean"


@dataclass
class Machine:
    """State between runs. Runs are (kind, first_ms, n): kind 2 for speech, 0 for quiet, 1 for what lies between."""

    cfg: SegmenterConfig
    inside: bool = False
    before: list[int] = field(default_factory=list)  # starts of the latest frames outside speech
    begin: int | None = None
    size: int = 0
    speech: int = 0
    quiet: int = 0

    def feed(self, kind: int, first_ms: int, n: int) -> Iterator[tuple]:
        cfg = self.cfg
        pre, most, hush, tail = (cfg.frames(x) for x in (cfg.pre_roll_ms, cfg.longest_ms, cfg.silence_ms, cfg.tail_ms))
        at = 0
        while at < n:
            here = first_ms + at * FRAME_MS
            if not self.inside:
                if kind == 2:
                    self.begin = self.before[0] if self.before else here
                    self.inside, self.size, self.speech, self.quiet, self.before = True, len(self.before) + 1, 1, 0, []
                    at += 1
                else:
                    kept = min(n - at, pre)
                    self.before = [*self.before, *(first_ms + k * FRAME_MS for k in range(n - kept, n))][-pre:]
                    at = n
                continue
            step = min(n - at, max(1, most - self.size))
            if kind == 0:
                step = min(step, hush - self.quiet)
            if self.begin is None:
                self.begin = here
            self.size += step
            at += step
            closing = first_ms + (at - 1) * FRAME_MS
            if kind == 2:
                self.speech, self.quiet = self.speech + step, 0
            elif kind == 0:
                self.quiet += step
            if self.quiet >= hush:
                yield from self._close(self.quiet - tail, False, closing)
                self.inside = False
            elif self.size >= most:
                yield from self._close(0, True, closing)

    def _close(self, cut: int, split: bool, closing: int) -> Iterator[tuple]:
        size = self.size - max(0, min(cut, self.size))
        if size:
            dropped = not split and self.speech < self.cfg.frames(self.cfg.shortest_ms)
            yield self.begin, size, self.speech * FRAME_MS, split, closing, dropped
        self.begin, self.size, self.speech, self.quiet = None, 0, 0, 0

    def flush(self, closing: int) -> Iterator[tuple]:
        if self.inside:
            yield from self._close(self.quiet - self.cfg.frames(self.cfg.tail_ms), False, closing)
        self.inside, self.before = False, []


def stretches_of(frames: DataFrame, cfg: SegmenterConfig, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """(owner_id, stretch, runs): frames of one kind in a row, without a gap in time, in the order of an owner's stretch of an hour: what one row holds is bounded by the hour."""
    kind = F.when(F.col("prob") >= cfg.start, 2).when(F.col("prob") < cfg.stop, 0).otherwise(1)
    rows = frames.filter(F.col("n_samples") == 512).select("owner_id", "frame_start_ms", kind.alias("kind"), F.floor(F.col("frame_start_ms") / stretch_ms).alias("stretch"))
    w = Window.partitionBy("owner_id", "stretch").orderBy("frame_start_ms")
    same = F.col("kind").eqNullSafe(F.lag("kind").over(w)) & (F.col("frame_start_ms") - F.lag("frame_start_ms").over(w) == FRAME_MS)
    marked = rows.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("owner_id", "stretch", "run").agg(F.first("kind").alias("kind"), F.min("frame_start_ms").alias("first_ms"), F.count("*").alias("n"))
    lists = runs.groupBy("owner_id", "stretch").agg(F.sort_array(F.collect_list(F.struct("run", "first_ms", "kind", "n"))).alias("runs"))
    return lists.select("owner_id", "stretch", F.transform("runs", lambda r: F.struct(r["first_ms"].alias("first_ms"), r["kind"].alias("kind"), r["n"].alias("n"))).alias("runs"))


class States:
    """The states that a stretch may be entered in, numbered: outside speech by the frames before (at most the pre-roll), inside by silence and size.

    Where a segment began and how much speech it has don't change what happens, so they are no part of a state.
    """

    def __init__(self, cfg: SegmenterConfig) -> None:
        self.pre, self.most, self.hush = (cfg.frames(x) for x in (cfg.pre_roll_ms, cfg.longest_ms, cfg.silence_ms))
        self.n = self.pre + 1 + self.hush * self.most

    def number(self, inside: bool, before: int, size: int, quiet: int) -> int:
        return self.pre + 1 + quiet * self.most + size if inside else before

    def machine(self, cfg: SegmenterConfig, state: int) -> Machine:
        """A machine in this state; what lies before the stretch is told by CARRIED and the numbers above it."""
        if state <= self.pre:
            return Machine(cfg, before=[CARRIED + 1 + k for k in range(state)])
        quiet, size = divmod(state - self.pre - 1, self.most)
        return Machine(cfg, inside=True, begin=CARRIED if size else None, size=size, quiet=quiet)

    def transition(self, runs: list[tuple[int, int]]) -> np.ndarray:
        """For every state at entry the one after the runs (kind, n). States that have met go on as one."""
        k = np.arange(self.n)
        inside = k > self.pre
        size, quiet, before = np.where(inside, (k - self.pre - 1) % self.most, 0), np.where(inside, (k - self.pre - 1) // self.most, 0), np.where(inside, 0, k)
        of = k
        for at, (kind, n) in enumerate(runs):
            left = np.full(len(inside), n)
            while left.any():
                starts = ~inside & (left > 0) & (kind == 2)
                waits = ~inside & ~starts
                goes = inside & (left > 0)
                step = np.minimum(left, np.maximum(1, self.most - size))
                if kind == 0:
                    step = np.minimum(step, self.hush - quiet)
                step = np.where(goes, step, 0)
                before = np.where(waits, np.minimum(before + left, self.pre), before)
                size = np.where(starts, before + 1, size + step)
                quiet = np.where(starts | (goes & (kind == 2)), 0, quiet + step if kind == 0 else quiet)
                left = np.where(waits, 0, left - step - starts)
                ends = goes & (quiet >= self.hush)
                splits = goes & ~ends & (size >= self.most)
                inside = (inside | starts) & ~ends
                before = np.where(starts | ends, 0, before)
                size, quiet = np.where(ends | splits, 0, size), np.where(ends | splits, 0, quiet)
            if at % 4 == 3 or at == len(runs) - 1:
                same, where = np.unique(np.where(inside, self.pre + 1 + quiet * self.most + size, before), return_inverse=True)
                of = where[of]
                inside = same > self.pre
                size, quiet, before = np.where(inside, (same - self.pre - 1) % self.most, 0), np.where(inside, (same - self.pre - 1) // self.most, 0), np.where(inside, 0, same)
        return np.where(inside, self.pre + 1 + quiet * self.most + size, before)[of]


def _runs(cell: pa.ListScalar) -> Iterator[tuple[int, int, int]]:
    rows = cell.values
    return zip(*(rows.field(c).to_pylist() for c in ("kind", "first_ms", "n")), strict=True)


def _left(machine: Machine) -> tuple:
    return machine.inside, machine.before, machine.begin, machine.size, machine.speech, machine.quiet


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    columns = list(zip(*rows, strict=True)) or [()] * len(schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], [x.split()[0] for x in schema.split(", ")])


def transitions(stretches: DataFrame, cfg: SegmenterConfig) -> DataFrame:
    """Per stretch how it is left: the state itself where the stretch settles it, else `after`, the number of the state for each one at entry.

    A stretch settles its state if it is the owner's first (column is_first) or has `cfg.safe` quiet frames in a row.
    """
    states = States(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                machine = Machine(cfg) if batch.column("is_first")[k].as_py() else None
                kept, hushed, recent, last = [], 0, [], None
                for kind, first_ms, n in _runs(batch.column("runs")[k]):
                    last = first_ms + (n - 1) * FRAME_MS
                    if machine is None:
                        kept.append((kind, n))
                        hushed = hushed + n if kind == 0 else 0
                        recent = [*recent, *(first_ms + j * FRAME_MS for j in range(max(0, n - states.pre), n))][-states.pre :] if kind == 0 else []
                        if hushed >= cfg.safe:
                            machine = Machine(cfg, before=recent)
                    else:
                        for _ in machine.feed(kind, first_ms, n):
                            pass
                key = (batch.column("owner_id")[k].as_py(), batch.column("stretch")[k].as_py())
                out.append((*key, [], True, *_left(machine), last) if machine else (*key, states.transition(kept).astype(np.int32), False, None, None, None, None, None, None, last))
            yield _batch(out, LEFT)

    return stretches.select("owner_id", "stretch", "runs", "is_first").mapInArrow(run, LEFT)


def _entered(left: DataFrame, cfg: SegmenterConfig) -> DataFrame:
    """(owner_id, stretch, state) of the stretches that don't settle their state: one step through an owner's rows of `left`, without runs."""
    states = States(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now = None, 0
        for batch in batches:
            out, columns = [], [batch.column(c).to_pylist() for c in ("owner_id", "stretch", "settled", "inside", "before", "size", "quiet")]
            for k, (owner, stretch, settled, inside, before, size, quiet) in enumerate(zip(*columns, strict=True)):
                if owner != here:
                    here, now = owner, 0
                if settled:
                    now = states.number(inside, len(before), size, quiet)
                else:
                    out.append((owner, stretch, now))
                    now = batch.column("after")[k].values[now].as_py()
            yield _batch(out, "owner_id string, stretch long, state int")

    return _in_order(left).mapInArrow(run, "owner_id string, stretch long, state int")


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("owner_id").sortWithinPartitions("owner_id", "stretch")


def _walked(stretches: DataFrame, entered: DataFrame, cfg: SegmenterConfig) -> DataFrame:
    """How the stretches are left that were entered in a known state, with CARRIED for what lies before them."""
    states = States(cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                machine, last = states.machine(cfg, batch.column("state")[k].as_py()), None
                for kind, first_ms, n in _runs(batch.column("runs")[k]):
                    last = first_ms + (n - 1) * FRAME_MS
                    for _ in machine.feed(kind, first_ms, n):
                        pass
                out.append((batch.column("owner_id")[k].as_py(), batch.column("stretch")[k].as_py(), [], False, *_left(machine), last))
            yield _batch(out, LEFT)

    rows = stretches.select("owner_id", "stretch", "runs").join(entered, ["owner_id", "stretch"])
    return rows.mapInArrow(run, LEFT)


def _entries(left: DataFrame, cfg: SegmenterConfig) -> DataFrame:
    """(owner_id, stretch, state at entry, is_last): one step through an owner's rows, in which CARRIED is replaced by what it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, waiting = None, Machine(cfg), None
        for batch in batches:
            out, columns = [], [batch.column(c).to_pylist() for c in ("owner_id", "stretch", "settled", "inside", "before", "begin", "size", "speech", "quiet")]
            for owner, stretch, settled, inside, before, begin, size, speech, quiet in zip(*columns, strict=True):
                if waiting is not None:
                    out.append((*waiting, owner != here))
                if owner != here:
                    here, now = owner, Machine(cfg)
                waiting = (owner, stretch, *_left(now))
                if not settled:
                    was = [now.begin, *now.before]
                    if begin is not None and begin <= CARRIED + len(now.before):
                        # the open segment is the one from before, or began with frames from before
                        speech += now.speech if begin == CARRIED else 0
                        begin = was[begin - CARRIED]
                    before = [was[x - CARRIED] if x <= CARRIED + len(now.before) else x for x in before]
                now = Machine(cfg, inside, before, begin, size, speech, quiet)
            yield _batch(out, ENTRY)
        if waiting is not None:
            yield _batch([(*waiting, True)], ENTRY)

    return _in_order(left.drop("after")).mapInArrow(run, ENTRY)


def segment_speech(frames: DataFrame, cfg: SegmenterConfig | None = None, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Segments (owner_id, start_ms, n_frames, speech_ms, split_by_max, close_ms, dropped) of frames (owner_id, frame_start_ms, prob, n_samples).

    Frames of another size than 512 are skipped. An owner's frames are cut into stretches of an hour, which are worked on side by side: first
    each tells how it is left, as a state or as a state for every one it may be entered in; one row a stretch is stepped
    through in order, which gives every stretch the state that it is entered in; then each makes its segments. No task sees more runs at
    once than those of a stretch, however busy an owner is and however seldom quiet.
    """
    cfg = cfg or SegmenterConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            fields = [batch.column(c).to_pylist() for c in ("owner_id", "inside", "before", "begin", "size", "speech", "quiet", "is_last")]
            for k, (owner, *state, is_last) in enumerate(zip(*fields, strict=True)):
                machine, last = Machine(cfg, *state), 0
                for kind, first_ms, n in _runs(batch.column("runs")[k]):
                    out += [(owner, *x) for x in machine.feed(kind, first_ms, n)]
                    last = first_ms + (n - 1) * FRAME_MS
                if is_last:
                    out += [(owner, *x) for x in machine.flush(last)]
            yield _batch(out, SEGMENTS)

    stretches = cut(stretches_of(frames, cfg, stretch_ms))
    first = stretches.groupBy("owner_id").agg(F.min("stretch").alias("stretch")).withColumn("is_first", F.lit(True))
    left = cut(transitions(stretches.join(first, ["owner_id", "stretch"], "left").fillna(False, ["is_first"]), cfg))
    walked = _walked(stretches, _entered(left, cfg), cfg)
    entries = _entries(left.filter("settled").unionByName(walked), cfg)
    return stretches.join(entries, ["owner_id", "stretch"]).mapInArrow(run, SEGMENTS)


#: A gap in time from which an owner's frames are a new session, and the longest stretch of one that a model sees at once.
SESSION_GAP_MS, STRETCH_FRAMES = 60_000, 20_000


def score_frames(frames: DataFrame, fn: Callable[[pd.DataFrame, object], tuple[pd.Series, object]], gap_ms: int = SESSION_GAP_MS, stretch: int = STRETCH_FRAMES) -> DataFrame:
    """frames with prob: fn(frames of a session in order, state) gives their probabilities and the state to go on with; the state is None at a session's start.

    A session ends where frames are more than `gap_ms` apart, or where the column session, if there is one, changes. Sessions are dealt over
    tasks; fn gets stretches of `stretch` frames at most, so a session of any length runs through bounded memory.
    """
    base = frames.drop("prob")
    if "session" in base.columns:
        session = F.struct("session")
    else:
        base = with_previous(base, ["frame_start_ms"], ["frame_start_ms"])
        opens = F.coalesce(F.col("frame_start_ms") - F.col("previous.frame_start_ms") > gap_ms, F.lit(True))
        base = since_mark(base.withColumn("opens", opens), "opens", "frame_start_ms", "session_ms").drop("previous", "opens")
        session = F.struct("session_ms")
    rows = base.withColumn("_session", session)
    names = frames.drop("prob").columns
    schema = frames.drop("prob").schema.add("prob", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, None
        for batch in batches:
            keys = [(o, *s) for o, s in zip(batch["owner_id"], map(_values, batch["_session"]), strict=True)]
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != here:
                    here, state = keys[a], None
                for at in range(a, b, stretch):
                    part = batch.iloc[at : min(b, at + stretch)].reset_index(drop=True)
                    prob, state = fn(part[names], state)
                    yield part[names].assign(prob=prob.astype(float).to_numpy())

    return rows.repartition("owner_id", "_session").sortWithinPartitions("owner_id", "_session", "frame_start_ms").mapInPandas(run, schema)


def _values(row: object) -> tuple:
    return tuple(row.values()) if isinstance(row, dict) else tuple(row)
