"""The live half of the diary: windows with a watermark, the segmenter as keyed state, idempotent appends, incremental day counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from daybook.operators.segmentation import FRAME_MS, SEGMENTS, Machine, SegmenterConfig
from daybook.operators.telemetry import capture_windows, frame_end, is_silent
from daybook.sources.day_counts import refresh_day_counts
from daybook.sources.diary import SAME, append_transcripts

_PROGRESS = "inside boolean, before array<long>, begin long, size long, speech long, quiet long, last_ms long, newest_ms long, due_ms long, firsts array<long>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Frames wait for the watermark by second, in blocks of a minute; others than of this size are skipped.
SECOND_MS, BLOCK_MS, FRAME_SAMPLES = 1000, 60_000, 512
_PACKED = "owner_id string, last_ms long, ms binary, kinds binary"


def capture_windows_stream(frames: DataFrame, window: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """capture_windows of a stream (owner_id, frame_start_ms, ..); a window is emitted when the watermark has passed it."""
    timed = frames.withColumn("ts", F.timestamp_millis("frame_start_ms")).withWatermark("ts", delay)
    return capture_windows(timed, window)


def silence_runs_stream(frames: DataFrame, min_ms: int = 10_000, delay: str = "10 seconds", frame_ms: int = FRAME_MS) -> DataFrame:
    """silence_runs of a stream: a run is a session of silent frames, given when the watermark has passed its end, with one alarm at most.

    A session ends where the next silent frame is more than a frame and a half away, so a loud frame ends it, and a pause in the recording too.
    """
    timed = frames.withColumn("end_ms", frame_end()).withColumn("ts", F.timestamp_millis("frame_start_ms")).withWatermark("ts", delay)
    session = F.session_window("ts", f"{frame_ms * 3 // 2} milliseconds")
    runs = timed.filter(is_silent()).groupBy("owner_id", session).agg(F.min("frame_start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_frames"))
    return runs.select("owner_id", "start_ms", "end_ms", "n_frames", (F.col("end_ms") - F.col("start_ms") > min_ms).alias("alarm"))


def rocksdb_state(spark: SparkSession) -> None:
    """Keeps the state of this session's streams in RocksDB, as segment_speech_stream needs it: state beyond the memory lies on disk, and checkpoints get the changes alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _packed(frames: DataFrame, cfg: SegmenterConfig) -> DataFrame:
    """Rows (owner_id, last_ms, ms, kinds): the frames of an owner's second that lie in one Arrow batch, as bytes. Those of another size are left out, but count for last_ms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("frame_start_ms").is_valid())
            owners = batch.column("owner_id").dictionary_encode("encode")
            codes, ms = owners.indices.to_numpy(), batch.column("frame_start_ms").to_numpy()
            prob, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("prob", "n_samples"))
            order = np.lexsort((ms, codes))
            codes, ms, prob, right = codes[order], ms[order], prob[order].astype(np.float64), n[order] == FRAME_SAMPLES
            kinds = np.where(prob >= cfg.start, 2, np.where(prob < cfg.stop, 0, 1)).astype(np.int8)
            new = np.ones(len(ms), bool)
            new[1:] = (np.diff(codes) != 0) | (np.diff(ms // SECOND_MS) != 0)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(ms)).astype(np.int64)[: len(starts)]
            kept = np.append(0, np.cumsum(right))
            offsets = np.append(kept[starts], kept[-1])
            binary = lambda values, size: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(values.tobytes())])
            owner = owners.dictionary.take(pa.array(codes[starts]))
            yield pa.RecordBatch.from_arrays([owner, pa.array(ms[ends - 1], pa.int64()), binary(ms[right], 8), binary(kinds[right], 1)], [x.split()[0] for x in _PACKED.split(", ")])

    return frames.select("owner_id", "frame_start_ms", "prob", "n_samples").mapInArrow(run, _PACKED)


class Segmenter(StatefulProcessor):
    """An owner's frames, rows of _packed(), wait in a map of blocks of a minute, as the bytes of their starts and kinds; a timer goes off when the watermark has passed
    the second of the first of them, and the frames that it has passed are stepped through in order, as runs of one kind.

    One batch touches the blocks that it has frames of, however many wait. The machine's own state is one small value, with the first frame of each block.
    """

    def __init__(self, cfg: SegmenterConfig, idle_ms: int) -> None:
        self.cfg, self.idle_ms = cfg, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", "ms binary, kinds binary")
        self.progress = handle.getValueState("progress", _PROGRESS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts = [(b"".join(f["ms"]), b"".join(f["kinds"])) for f in rows]
        ms, kinds = (np.frombuffer(b"".join(c), t) for c, t in zip(zip(*parts, strict=True), (np.int64, np.int8), strict=True))
        if not len(ms):
            return
        order = np.argsort(ms, kind="stable")
        ms, kinds = ms[order], kinds[order]
        machine, last, newest, due, firsts = self._progress()
        held = {first // BLOCK_MS: first for first in firsts}
        blocks = ms // BLOCK_MS
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(ms)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            block, first, more = int(blocks[a]), int(ms[a]), (ms[a:b].tobytes(), kinds[a:b].tobytes())
            if block in held:
                old = self.waiting.getValue((block,))
                more, first = (bytes(old[0]) + more[0], bytes(old[1]) + more[1]), min(first, held[block])
            held[block] = first
            self.waiting.updateValue((block,), more)
        newest = max(int(ms[-1]), newest or 0)
        first = (int(ms[0]) // SECOND_MS + 1) * SECOND_MS
        # one timer an owner: that of the first second that waits, or of the pause after the last frame
        if due is None or first < due:
            due = self._timer(due, first)
        self._keep(machine, last, newest, due, sorted(held.values()))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        passed = mark // SECOND_MS * SECOND_MS
        machine, last, newest, _, firsts = self._progress()
        out: list[tuple] = []
        left: list[int] = []
        for first in firsts:
            if first >= passed:
                left.append(first)
                continue
            block = first // BLOCK_MS
            ms, kinds = (np.frombuffer(bytes(x), t) for x, t in zip(self.waiting.getValue((block,)), (np.int64, np.int8), strict=True))
            order = np.lexsort((kinds, ms))
            ms, kinds = ms[order], kinds[order]
            n = int(np.searchsorted(ms, passed))
            if n < len(ms):
                left.append(int(ms[n]))
                self.waiting.updateValue((block,), (ms[n:].tobytes(), kinds[n:].tobytes()))
            else:
                self.waiting.removeKey((block,))
            cuts = [0, *(np.flatnonzero((np.diff(ms[:n]) != FRAME_MS) | (np.diff(kinds[:n]) != 0)) + 1).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out += machine.feed(int(kinds[a]), int(ms[a]), b - a)
            last = int(ms[n - 1])
        if left:
            self._keep(machine, last, newest, self._timer(None, (left[0] // SECOND_MS + 1) * SECOND_MS), left)
        elif mark >= newest + self.idle_ms:
            out += machine.flush(last)
            self.progress.clear()
        else:
            self._keep(machine, last, newest, self._timer(None, newest + self.idle_ms), left)
        if out:
            frame = pd.DataFrame(out, columns=["start_ms", "n_frames", "speech_ms", "split_by_max", "close_ms", "dropped"])
            frame.insert(0, "owner_id", key[0])
            yield frame

    def close(self) -> None:
        pass

    def _progress(self) -> tuple[Machine, int | None, int | None, int | None, list[int]]:
        kept = self.progress.get()
        if kept is None:
            return Machine(self.cfg), None, None, None, []
        inside, before, begin, size, speech, quiet, last, newest, due, firsts = kept
        return Machine(self.cfg, inside, list(before), begin, size, speech, quiet), last, newest, due, list(firsts)

    def _keep(self, machine: Machine, last: int | None, newest: int, due: int, firsts: list[int]) -> None:
        self.progress.update((machine.inside, machine.before, machine.begin, machine.size, machine.speech, machine.quiet, last, newest, due, firsts))

    def _timer(self, old: int | None, new: int) -> int:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)
        return new


def segment_speech_stream(frames: DataFrame, cfg: SegmenterConfig | None = None, delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Segments of a stream of frames, equal to segment_speech of the same frames.

    Frames of an owner wait until the watermark has passed their second, then they are stepped through in order; a gap is no silence. When
    an owner's frames end for `idle_ms` of event time, what is open is flushed. Frames whose second is behind the watermark never reach the state,
    for which they are packed by second. The session needs rocksdb_state().
    """
    cfg = cfg or SegmenterConfig()
    timed = _packed(frames, cfg).select("owner_id", "ms", "kinds", F.timestamp_millis("last_ms").alias("ts")).withWatermark("ts", delay)
    return timed.groupBy("owner_id").transformWithStateInPandas(Segmenter(cfg, idle_ms), SEGMENTS, "append", "EventTime")


def append_stream(transcripts: DataFrame, path: str, checkpoint: str, name: str = "transcripts", delay: str = "1 hour") -> StreamingQuery:
    """Appends transcripts as they come, each segment (by start and id) and model once: what is told again within the delay (of created_ms) is dropped in the
    stream's state, and the ledger of batches keeps a batch that runs again from adding anything. Rows created before the watermark are dropped."""
    timed = transcripts.withColumn("ts", F.timestamp_millis("created_ms")).withWatermark("ts", delay)
    once = timed.dropDuplicatesWithinWatermark(SAME).drop("ts")
    return once.writeStream.foreachBatch(lambda batch, k: append_transcripts(batch, path, k, name, repeats=False)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_stream(rows: DataFrame, table: str, counts: str, source: str, checkpoint: str) -> StreamingQuery:
    """Appends rows with a day to a table, each batch to a folder of its own, and keeps the counts of the days that the batch touches."""

    def put(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        # a batch that is run again replaces what it wrote
        batch.withColumn("batch_id", F.lit(k)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(table)
        now = spark.read.schema(batch.schema).parquet(table)
        refresh_day_counts(now, batch, counts, source)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_stats_stream(transcripts: DataFrame) -> DataFrame:
    """Counts and newest created_ms per day, kept up to date. Late rows count: they reopen a day, so there is no watermark."""
    return transcripts.groupBy("owner_id", "day").agg(F.count("*").alias("count"), F.max("created_ms").alias("max_created_ms"))
