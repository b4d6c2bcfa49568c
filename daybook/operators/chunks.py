"""The chunk index: packing transcripts, rendering digests, hashes, and what has changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.textops import without_times, words
from daybook.functions.timeutil import day_end, day_start, hhmm, hour_start
from daybook.functions.vectors import l2_normalize, quantize
from daybook.operators.digests import parse_digests, render_digests
from daybook.schemas import DAY, HOUR, HOUR_MS, TRANSCRIPT

TARGET_WORDS, MAX_WORDS = 180, 280
_DRAFT = "owner_id string, day string, kind string, start_ms long, end_ms long, text string, ord long"


class _Hour:
    """Chunks of one local hour, line by line. A chunk is closed as soon as it has the target, or before a part that would exceed the most."""

    def __init__(self, key: tuple, target: int, most: int) -> None:
        self.key, self.target, self.most = key, target, most
        self.done: list[tuple] = []
        self.lines: list[str] = []
        self.held = self.begin = self.end = 0

    def add(self, start_ms: int, end_ms: int, stamp: str, text: str | None) -> None:
        found = (text or "").split()
        for at in range(0, len(found), self.most):
            part = found[at : at + self.most]
            if self.held and self.held + len(part) > self.most:
                self.close()
            if not self.lines:
                self.begin = start_ms
            self.lines.append(f"[{stamp}] {' '.join(part)}")
            self.held, self.end = self.held + len(part), end_ms
            if self.held >= self.target:
                self.close()

    def close(self) -> None:
        if self.lines:
            self.done.append((*self.key[:2], TRANSCRIPT, self.begin, self.end, "\n".join(self.lines), len(self.done)))
        self.lines, self.held = [], 0


def chunk_transcripts(transcripts: DataFrame, zone: str | Column, target: int = TARGET_WORDS, most: int = MAX_WORDS) -> DataFrame:
    """Drafts (owner_id, day, kind, start_ms, end_ms, text, ord) of each owner's local hours. Hours are dealt over tasks; a task goes through
    its sorted rows and holds the chunks of one hour."""
    rows = transcripts.select("owner_id", "day", hour_start(F.col("start_ms"), zone).alias("hour_ms"), "start_ms", "id", "end_ms", hhmm(F.col("start_ms"), zone).alias("stamp"), "text")
    names = [x.split()[0] for x in _DRAFT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def made(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [()] * len(kinds), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hour = None
        for batch in batches:
            out: list[tuple] = []
            for owner, day, hour_ms, start_ms, _, end_ms, stamp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hour is None or hour.key != (owner, day, hour_ms):
                    if hour is not None:
                        hour.close()
                        out += hour.done
                    hour = _Hour((owner, day, hour_ms), target, most)
                hour.add(start_ms, end_ms, stamp, text)
            yield made(out)
        if hour is not None:
            hour.close()
            yield made(hour.done)

    keys = ["owner_id", "day", "hour_ms"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "start_ms", "id").mapInArrow(run, _DRAFT)


def chunk_digests(summaries: DataFrame, zone: str | Column) -> DataFrame:
    """Drafts of the non-empty digests: an hour from its start to its end, a day from local midnight to the next."""
    parsed = parse_digests(summaries)
    begin = F.when(F.col("kind") == DAY, day_start(F.col("day"), zone)).otherwise(F.col("period_start_ms"))
    end = F.when(F.col("kind") == DAY, day_end(F.col("day"), zone)).otherwise(F.col("period_start_ms") + HOUR_MS)
    span = F.concat(F.lit("Сводка за "), hhmm(F.col("period_start_ms"), zone), F.lit("–"), hhmm(F.col("period_start_ms") + HOUR_MS, zone))
    title = F.when(F.col("kind") == DAY, F.lit("Итог дня")).otherwise(span)
    drafts = parsed.select("owner_id", "day", "kind", begin.alias("start_ms"), end.alias("end_ms"), render_digests(F.col("digest"), title).alias("text"))
    # after an owner's transcripts of the day: hours, then the day
    return drafts.filter("text IS NOT NULL").withColumn("ord", F.when(F.col("kind") == HOUR, F.lit(1 << 40)).otherwise(F.lit(1 << 41)).cast("long"))


def chunk_hash(kind: Column, text: Column) -> Column:
    return F.sha1(F.concat(kind, F.lit("\n"), text).cast("binary"))


def hash_chunks(drafts: DataFrame) -> DataFrame:
    """Drafts with hash and id; of equal hashes of a day the first in order stays. Ids follow from owner, day and hash alone."""
    hashed = drafts.withColumn("hash", chunk_hash(F.col("kind"), F.col("text")))
    first = hashed.groupBy("owner_id", "day", "hash").agg(F.min(F.struct("ord", "start_ms", "kind", "end_ms", "text")).alias("d"))
    return first.select("owner_id", F.xxhash64("owner_id", "day", "hash").alias("id"), "day", "d.kind", "d.start_ms", "d.end_ms", "d.text", "hash")


def day_stats(df: DataFrame) -> DataFrame:
    """Per owner and day: count and max_created_ms."""
    return df.groupBy("owner_id", "day").agg(F.count("*").alias("count"), F.max("created_ms").alias("max_created_ms"))


def changed_days(transcripts: DataFrame, summaries: DataFrame, index_days: DataFrame) -> DataFrame:
    """(owner_id, day, signature) of the days whose sources differ from what was indexed."""
    return changed_stats(day_stats(transcripts), day_stats(summaries), index_days)


def changed_stats(transcript_days: DataFrame, summary_days: DataFrame, index_days: DataFrame) -> DataFrame:
    """changed_days from the counts of both sources: rows of day_stats."""
    t = transcript_days.select("owner_id", "day", F.col("count").alias("tc"), F.col("max_created_ms").alias("tm"))
    s = summary_days.select("owner_id", "day", F.col("count").alias("sc"), F.col("max_created_ms").alias("sm"))
    part = lambda c, m: F.concat(F.coalesce(c, F.lit(0)).cast("string"), F.lit(":"), F.coalesce(m, F.lit(0)).cast("string"))
    now = t.join(s, ["owner_id", "day"], "full_outer").select("owner_id", "day", F.concat(F.lit("t"), part(F.col("tc"), F.col("tm")), F.lit("|s"), part(F.col("sc"), F.col("sm"))).alias("signature"))
    before = index_days.select("owner_id", "day", F.col("signature").alias("old"))
    return now.join(before, ["owner_id", "day"], "left").filter(~F.col("signature").eqNullSafe(F.col("old"))).select("owner_id", "day", "signature")


def sync_chunks(chunks: DataFrame, drafts: DataFrame, changed: DataFrame, live_days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks after the changed days were chunked anew, and (owner_id, day, added, removed) of the days that differ.

    drafts are hash_chunks() rows of the changed days. Rows whose hash is still there keep id and vector; only keys are compared,
    so vectors move once. Days without sources (not in live_days) lose their chunks.
    """
    keys = ["owner_id", "day", "hash"]
    new_keys, old_keys = drafts.select(*keys), chunks.select(*keys)
    touched = changed.select("owner_id", "day").distinct()
    live = live_days.select("owner_id", "day").distinct()
    still = chunks.join(live, ["owner_id", "day"], "left_semi")
    same = still.join(touched, ["owner_id", "day"], "left_anti").unionByName(still.join(touched, ["owner_id", "day"], "left_semi").join(new_keys, keys, "left_semi"))
    added = drafts.join(touched, ["owner_id", "day"], "left_semi").join(old_keys, keys, "left_anti")
    kind = chunks.schema["vector"].dataType
    after = same.unionByName(added.select("owner_id", "id", "day", "kind", "start_ms", "end_ms", "text", "hash", F.lit(None).cast(kind).alias("vector"), F.lit("").alias("model")))
    gone = old_keys.join(after.select(*keys), keys, "left_anti").groupBy("owner_id", "day").agg(F.count("*").alias("removed"))
    report = added.groupBy("owner_id", "day").agg(F.count("*").alias("added")).join(gone, ["owner_id", "day"], "full_outer")
    return after, report.select("owner_id", "day", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


def index_markers(changed: DataFrame, drafts: DataFrame, index_days: DataFrame, live_days: DataFrame, now_ms: int) -> DataFrame:
    """index_days after a sync: the changed days' new signatures and chunk counts, the others that still have sources as they were."""
    counts = drafts.groupBy("owner_id", "day").agg(F.count("*").alias("chunks"))
    new = changed.join(counts, ["owner_id", "day"], "left").select("owner_id", "day", "signature", F.lit(now_ms).cast("long").alias("indexed_ms"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    old = index_days.join(changed, ["owner_id", "day"], "left_anti").join(live_days.select("owner_id", "day").distinct(), ["owner_id", "day"], "left_semi")
    return old.unionByName(new)


def pending_embeddings(chunks: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """Chunks without a vector of the model, the newest day first."""
    rows = chunks.filter(F.col("vector").isNull() | ~F.col("model").eqNullSafe(F.lit(model))).orderBy(F.desc("day"), "start_ms", "id")
    return rows if limit is None else rows.limit(limit)


def embedding_text(text: Column) -> Column:
    return without_times(text)


def embed_chunks(chunks: DataFrame, fn: Callable[[pd.Series], pd.Series], model: str) -> DataFrame:
    """All chunks, those pending with a vector: fn takes texts and gives a list of floats for each; vectors are normalised and quantised."""
    todo = F.col("vector").isNull() | ~F.col("model").eqNullSafe(F.lit(model))
    embed = F.pandas_udf(fn, "array<float>")
    pending = chunks.filter(todo)
    vector = quantize(l2_normalize(F.col("_v")), single=False)
    done = pending.withColumn("_v", embed(embedding_text(F.col("text")))).withColumn("vector", vector).withColumn("model", F.lit(model)).drop("_v")
    return chunks.filter(~todo).unionByName(done)


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count("vector").alias("embedded"), F.count_distinct("day").alias("days"))


def build_postings(chunks: DataFrame) -> DataFrame:
    """(owner_id, word, chunk_id, day, start_ms): each word of a chunk once."""
    return chunks.select("owner_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"), F.col("id").alias("chunk_id"), "day", "start_ms")


def newest_first(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("start_ms"), "chunk_id")
