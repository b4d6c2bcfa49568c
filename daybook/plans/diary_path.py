"""The whole way of a diary, from frames to cited answers: each step takes up what is new and leaves the rest as it is."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.vectors import l2_normalize
from daybook.operators import chunks, context, dates, search, summaries, transcription
from daybook.operators.segmentation import FRAME_MS, segment_speech
from daybook.plans import index, summarize
from daybook.schemas import SUMMARIES
from daybook.sources import diary, segments
from daybook.sources.chunk_store import ChunkStore
from daybook.sources.shared import cut

RATE = 16_000


def buffer_speech(frames: DataFrame, audio: Callable[[DataFrame], DataFrame], folder: str, key: bytes) -> None:
    """Segments of the frames, sealed, as files of their owners' folders; audio gives the segments (owner_id, start_ms, end_ms) their pcm_bytes."""
    found = segment_speech(frames).filter("NOT dropped").select("owner_id", "start_ms", (F.col("start_ms") + F.col("n_frames") * FRAME_MS).alias("end_ms"))
    rows = audio(found).select("owner_id", "start_ms", F.lit(RATE).alias("sample_rate"), F.floor(F.octet_length("pcm_bytes") / 2).cast("int").alias("num_samples"), "pcm_bytes")
    name = F.concat("owner_id", F.lit("/"), F.col("start_ms").cast("string"), F.lit(".bseg"))
    segments.write_segments(segments.seal_segments(rows, key).select(name.alias("name"), "blob"), folder)


def transcribe_buffer(spark: SparkSession, folder: str, key: bytes, path: str, hear: Callable[[pd.Series], pd.DataFrame], zone: str, model: str, now_ms: int) -> None:
    """Appends what is heard in the files of the buffer to the diary under path. Files that can't be opened have no text."""
    opened = segments.open_segments(segments.scan_segments(spark, folder), key).filter("pcm_bytes IS NOT NULL")
    rows = opened.select(F.element_at(F.split("path", "/"), -2).alias("owner_id"), "start_ms", "end_ms", F.col("pcm_bytes").alias("payload"))
    heard = transcription.to_transcripts(transcription.transcribe(rows, hear), zone, model, now_ms)
    diary.append_transcripts(cut(heard), path)


def summarize_diary(spark: SparkSession, path: str, llm: summarize.Llm, zone: str, now_ms: int, budget: int) -> DataFrame:
    """Makes the digests that the plan asks for and puts them in place; gives all summaries."""
    told = diary.read_table(spark, path, "transcripts")
    old = diary.read_table(spark, path, "summaries") if diary.exists(spark, f"{path}/summaries") else spark.createDataFrame([], SUMMARIES)
    made = cut(summarize.summarize(told, old, llm, now_ms, True, zone, budget))
    after = summaries.upsert_summaries(old, made.select(old.columns)).join(made.select("day").distinct(), "day", "left_semi")
    if not made.isEmpty():
        diary.write_day(cut(after), path, "summaries")
    return diary.read_table(spark, path, "summaries")


def index_diary(spark: SparkSession, path: str, store: ChunkStore, embed: Callable[[pd.Series], pd.Series], model: str, zone: str, now_ms: int) -> DataFrame:
    """Chunks the changed days anew and gives chunks without a vector theirs; gives the report of the sync."""
    told, made = diary.read_table(spark, path, "transcripts"), diary.read_table(spark, path, "summaries")
    changed = cut(chunks.changed_days(told, made, store.index_days()))
    of = lambda rows: rows.join(changed.select("owner_id", "day"), ["owner_id", "day"], "left_semi")
    drafts = cut(chunks.hash_chunks(chunks.chunk_transcripts(of(told), zone).unionByName(chunks.chunk_digests(of(made), zone))))
    report = index.sync_index(store, drafts, changed, told.select("owner_id", "day").unionByName(made.select("owner_id", "day")), now_ms)
    days = sorted(r.day for r in chunks.pending_embeddings(store.chunks(), model).select("day").distinct().collect())
    if days:
        store.commit(chunks.embed_chunks(store.chunks(days), embed, model), store.index_days(days), days)
    return report


def ask(questions: DataFrame, store: ChunkStore, embed: Callable[[pd.Series], pd.Series], model: str, llm: Callable[[pd.DataFrame], pd.Series], zone: str, budget: int) -> DataFrame:
    """(qid, answer, cited) of questions (qid, owner_id, text, today)."""
    asked = cut(search.question_stems(dates.resolve_date_hints(questions)).withColumn("vec", F.pandas_udf(embed, "array<float>")("text")))
    asked = asked.withColumn("vec", l2_normalize(F.col("vec")))
    every = store.chunks()
    hits = search.hybrid_search(asked, every, chunks.build_postings(every), model)
    found = hits.join(every.withColumnRenamed("id", "chunk_id"), "chunk_id").withColumnRenamed("chunk_id", "id")
    answered = context.answer_questions(context.build_contexts(asked, found, budget, zone), llm)
    return context.cited_sources(answered).select("qid", "answer", "cited")
