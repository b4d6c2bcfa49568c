"""The whole way from frames to a cited answer, and a second run that finds nothing new."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from daybook.functions import models
from daybook.plans import diary_path
from daybook.sources import diary
from daybook.sources.chunk_store import ChunkStore

KEY, NOW = bytes(range(16)), 1_790_800_000_000
START = int(dt.datetime(2026, 9, 29, 10, tzinfo=dt.timezone.utc).timestamp() * 1000)
SAID = {("anna", START): "обещала позвонить Саше насчет билетов", ("anna", START + 60_000): "купить молоко и хлеб", ("boris", START): "встреча с подрядчиком перенесена"}


def frames(spark, said):
    rows = [(o, at + 32 * k, 0.9 if 10 <= k < 50 else 0.1, 512) for o, at in said for k in range(120)]
    return spark.createDataFrame(rows, "owner_id string, frame_start_ms long, prob double, n_samples int")


def run(spark, tmp_path, said):
    def audio(found):
        # the bytes of what was said stand for its sound
        told = spark.createDataFrame([(o, at, bytearray((t if len(t.encode()) % 2 == 0 else t + " ").encode())) for (o, at), t in said.items()], "owner_id string, start_ms long, pcm_bytes binary")
        assert {(r.owner_id, r.start_ms) for r in found.collect()} == set(said)
        return found.join(told, ["owner_id", "start_ms"])

    def hear(payload):
        return pd.DataFrame({"text": payload.map(lambda b: bytes(b).decode()), "lang": "ru", "took_ms": payload.map(len)})

    folder, path, store = str(tmp_path / "buffer"), str(tmp_path / "diary"), ChunkStore(spark, str(tmp_path / "index"))
    diary_path.buffer_speech(frames(spark, said), audio, folder, KEY)
    diary_path.transcribe_buffer(spark, folder, KEY, path, hear, "UTC", "asr", NOW)
    diary_path.summarize_diary(spark, path, models.first_words_llm, "UTC", NOW, 400)
    report = diary_path.index_diary(spark, path, store, models.hash_embedder, "hash64", "UTC", NOW)
    return path, store, {(r.owner_id, r.added, r.removed) for r in report.collect()}


def test_from_frames_to_a_cited_answer(spark, tmp_path):
    path, store, report = run(spark, tmp_path, SAID)
    # the hour's transcripts in one chunk, its digest and the day's
    assert report == {("anna", 3, 0), ("boris", 3, 0)}
    assert {r.text for r in diary.read_table(spark, path, "transcripts").collect()} == set(SAID.values())
    rows = store.chunks().collect()
    assert {r.kind for r in rows} == {"TRANSCRIPT", "HOUR", "DAY"} and all(r.model == "hash64" and r.vector is not None for r in rows)
    q = spark.createDataFrame([(1, "anna", "что я обещала Саше?", dt.date(2026, 9, 30)), (2, "boris", "что было вчера", dt.date(2026, 9, 30)), (3, "nobody", "встреча", dt.date(2026, 9, 30))], "qid long, owner_id string, text string, today date")
    got = {r.qid: r for r in diary_path.ask(q, store, models.hash_embedder, "hash64", models.citing_llm, "UTC", 900).collect()}
    assert got[1].answer.startswith("Ответ [1].") and len(got[1].cited) == 1 and "29 сентября 2026" in got[1].cited[0].label
    labels = {s.chunk_id: s.label for s in got[1].cited + got[2].cited}
    owners = {r.id: r.owner_id for r in rows}
    assert {owners[c] for c in labels} == {"anna", "boris"}
    assert got[3].cited == [] and "не нашлось" in got[3].answer
    # the same again: nothing is heard, summed up or chunked twice
    version = store.version()
    assert run(spark, tmp_path, SAID)[2] == set() and store.version() == version
    assert diary.read_table(spark, path, "transcripts").count() == 3
    # one more segment of one owner: only its day changes, and vectors of what stays are kept
    more = {**SAID, ("boris", START + 7_200_000): "заказать трубы"}
    assert {o for o, _, _ in run(spark, tmp_path, more)[2]} == {"boris"}
    assert store.chunks().filter(F.col("text").contains("трубы")).count() >= 1 and store.chunks().filter("vector IS NULL").isEmpty()
