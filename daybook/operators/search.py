"""Retrieval for batches of questions: keywords by prefix, vectors, and both fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.textops import stems
from daybook.operators import vector_index
from daybook.operators.chunks import newest_first
from daybook.schemas import DAY

KEYWORD_HITS, RANKED, LIMIT, RRF_K, DIGEST_DAYS, NARROW = 200, 30, 12, 60, 14, 3
#: Milliseconds of a block of a stem's places: a day.
BLOCK_MS = 86_400_000
OPEN_FROM, OPEN_TO = "0000-00-00", "9999-99-99"


def question_stems(questions: DataFrame) -> DataFrame:
    """questions with stems; words of a date phrase (date_words, if the column is there) are left out."""
    used = F.col("date_words") if "date_words" in questions.columns else None
    return questions.withColumn("stems", stems(F.col("text"), used))


def _ranges(questions: DataFrame) -> DataFrame:
    """questions with the range as text, open where there is none."""
    text = lambda c, default: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(default)) if c in questions.columns else F.lit(default)
    return questions.withColumn("lo", text("from_day", OPEN_FROM)).withColumn("hi", text("to_day", OPEN_TO))


def keyword_search(questions: DataFrame, postings: DataFrame, limit: int = KEYWORD_HITS) -> DataFrame:
    """(qid, chunk_id, start_ms, matched): chunks that have a word beginning with a stem, the newest `limit` of each question.

    A stem is matched by equality with the beginning of the same length of every word, for the lengths that stems have, on
    the distinct words of an owner: the prefix search is an equi-join. matched counts the distinct stems in the chunk.

    A chunk among the newest of a question is among the newest of each of its stems, so a stem's places are cut to the newest `limit` in range
    before they meet the question. Counts by stem and day of time tell which days hold those; places of other days are never joined.
    """
    asked = _ranges(questions).select("qid", "owner_id", "lo", "hi", F.explode("stems").alias("stem"))
    asks = asked.select("owner_id", "stem", "lo", "hi").distinct()
    stem_keys = asked.select("owner_id", "stem").distinct()
    lengths = stem_keys.select("owner_id", F.char_length("stem").alias("n")).distinct()
    vocabulary = postings.select("owner_id", "word").distinct()
    beginnings = vocabulary.join(lengths, "owner_id").filter(F.char_length("word") >= F.col("n")).select("owner_id", "word", F.substring("word", F.lit(1), F.col("n")).alias("stem"))
    matching = beginnings.join(stem_keys, ["owner_id", "stem"]).select("owner_id", "word", "stem")
    places = postings.join(matching, ["owner_id", "word"]).select("owner_id", "stem", "chunk_id", "day", "start_ms").distinct().withColumn("block", F.floor(F.col("start_ms") / BLOCK_MS))
    newest = newest_blocks(asks, places, limit)
    lists = newest.join(places, ["owner_id", "stem", "block"]).filter("day BETWEEN lo AND hi")
    order = Window.partitionBy("owner_id", "stem", "lo", "hi").orderBy(F.desc("start_ms"), "chunk_id")
    lists = lists.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n", "block")
    hits = asked.join(lists, ["owner_id", "stem", "lo", "hi"]).groupBy("qid", "chunk_id", "start_ms").agg(F.count_distinct("stem").alias("matched"))
    return hits.withColumn("n", F.row_number().over(newest_first("qid"))).filter(F.col("n") <= limit).drop("n")


def newest_blocks(asks: DataFrame, places: DataFrame, limit: int) -> DataFrame:
    """(owner_id, stem, lo, hi, block): for each ask the newest blocks of time that together hold `limit` of its stem's places in range, or all there are."""
    counts = places.groupBy("owner_id", "stem", "block", "day").agg(F.count("*").alias("n"))
    per = asks.join(counts, ["owner_id", "stem"]).filter("day BETWEEN lo AND hi").groupBy("owner_id", "stem", "lo", "hi", "block").agg(F.sum("n").alias("n"))
    newer = Window.partitionBy("owner_id", "stem", "lo", "hi").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("n").over(newer), F.lit(0))).filter(F.col("before") < limit).drop("n", "before")


def rank_by_stems(hits: DataFrame, top: int = RANKED) -> DataFrame:
    """(qid, chunk_id, rank): most distinct stems first, then the newest."""
    order = Window.partitionBy("qid").orderBy(F.desc("matched"), F.desc("start_ms"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("qid", "chunk_id", "rank")


def vector_search(questions: DataFrame, chunks: DataFrame, model: str, top: int = RANKED) -> DataFrame:
    """(qid, chunk_id, score, rank) of the chunks nearest to vec, within the question's owner and range.

    The chunks are clustered, and a question opens a cluster only while it may hold one of its nearest: see vector_index. Scores are
    rounded to six digits, ties keep the lower id.
    """
    asked = _ranges(questions.filter("vec IS NOT NULL")).select("qid", "owner_id", "lo", "hi", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    rows = chunks.filter(F.col("vector").isNotNull() & (F.col("model") == model)).select("owner_id", F.col("id").alias("chunk_id"), "day", F.col("vector.scale").alias("scale"), F.col("vector.q").alias("q"))
    return vector_index.search(vector_index.VectorIndex(rows), asked, top)


def fuse_rrf(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, id, score, rank) of rankings (qid, list_no, pos, id): sum of 1 / (k + rank), ranks from 1 without repeats in a list; ties by the first appearance."""
    first = rankings.groupBy("qid", "list_no", "id").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("qid", "list_no").orderBy("pos", "id")))
    fused = ranked.groupBy("qid", "id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("r"))), 9).alias("score"), F.min(F.struct("list_no", "r")).alias("seen"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "seen", "id"))).drop("seen")


def _search_in(questions: DataFrame, chunks: DataFrame, postings: DataFrame, model: str | None, limit: int) -> DataFrame:
    text = rank_by_stems(keyword_search(questions, postings)).select("qid", F.lit(0).alias("list_no"), F.col("rank").alias("pos"), F.col("chunk_id").alias("id"))
    lists = text
    if model is not None and "vec" in questions.columns:
        lists = text.unionByName(vector_search(questions, chunks, model).select("qid", F.lit(1).alias("list_no"), F.col("rank").alias("pos"), F.col("chunk_id").alias("id")))
    via = lists.groupBy("qid", "id").agg(F.bool_or(F.col("list_no") == 0).alias("via_text"), F.bool_or(F.col("list_no") == 1).alias("via_vector"))
    return fuse_rrf(lists).filter(F.col("rank") <= limit).join(via, ["qid", "id"]).select("qid", "rank", F.col("id").alias("chunk_id"), "score", "via_text", "via_vector")


def day_digest_chunks(chunks: DataFrame, days: DataFrame) -> DataFrame:
    """DAY chunks of (qid, owner_id, day) rows."""
    own = chunks.filter(F.col("kind") == DAY).select("owner_id", "day", F.col("id").alias("chunk_id"))
    return days.join(own, ["owner_id", "day"])


def fetch_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of chunks whose id is among ids (chunk_id)."""
    return chunks.join(ids.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")


def hybrid_search(questions: DataFrame, chunks: DataFrame, postings: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(qid, rank, chunk_id, score, via_text, via_vector).

    Keyword and vector lists fused, the best `limit`. A question with a range and fewer than three hits is filled up with hits of any
    day; one with a range also gets the day digests of the first fourteen days of it in front, with score 1, so it may have more than `limit`.
    """
    ranged = F.col("from_day").isNotNull() if "from_day" in questions.columns else F.lit(False)
    # a question with a range is searched twice in one pass: within it (even keys), and on all days (odd keys)
    asked = questions.withColumn("_ranged", ranged).withColumn("_wide", F.explode(F.when(F.col("_ranged"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    asked = asked.withColumn("qid", F.col("qid") * 2 + F.col("_wide"))
    for c in ("from_day", "to_day"):
        if c in questions.columns:
            asked = asked.withColumn(c, F.when(F.col("_wide") == 0, F.col(c)))
    found = _search_in(asked.drop("_wide", "_ranged"), chunks, postings, model, limit)
    found = found.withColumn("wide", F.pmod("qid", F.lit(2))).withColumn("qid", F.floor(F.col("qid") / 2))
    of_question, of_hit = Window.partitionBy("qid"), Window.partitionBy("qid", "chunk_id")
    found = found.withColumn("n", F.count_if(F.col("wide") == 0).over(of_question)).filter((F.col("wide") == 0) | (F.col("n") < NARROW))
    found = found.withColumn("first", F.min("wide").over(of_hit)).filter("wide = first")
    found = found.withColumn("rank", F.row_number().over(of_question.orderBy("wide", "rank"))).filter(F.col("rank") <= limit).select("qid", "rank", "chunk_id", "score", "via_text", "via_vector")
    if "from_day" in questions.columns:
        days = questions.filter(ranged).select("qid", "owner_id", F.explode(F.sequence("from_day", F.least(F.col("to_day"), F.date_add("from_day", DIGEST_DAYS - 1)))).alias("d")).select("qid", "owner_id", F.date_format("d", "yyyy-MM-dd").alias("day"))
        front = day_digest_chunks(chunks, days).select("qid", (F.row_number().over(of_question.orderBy("day", "chunk_id")) - 1000).alias("rank"), "chunk_id", F.lit(1.0).alias("score"), F.lit(False).alias("via_text"), F.lit(False).alias("via_vector"))
        # a digest that was found anyway keeps its place
        found = found.unionByName(front).withColumn("best", F.max("rank").over(of_hit)).filter("rank = best").drop("best")
    return found.withColumn("rank", F.row_number().over(of_question.orderBy("rank")))
