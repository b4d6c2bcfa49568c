"""Vector and keyword search against plain versions, with blocks, ranges and limits that bite."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.functions import textops, vectors
from daybook.operators import chunks, search, vector_index

CHUNKS = "owner_id string, id long, day string, model string, v array<float>"
QUESTIONS = "qid long, owner_id string, text string, vec array<float>, from_day date, to_day date"


def clustered(rng, n, dim, groups, spread):
    centres = rng.normal(0, 1, (groups, dim))
    x = centres[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def corpus(spark, seed=2, n=900, dim=12, spread=0.1):
    rng = np.random.default_rng(seed)
    x = clustered(rng, n, dim, 9, spread)
    rows = [("a" if k % 3 else "b", k, f"2024-01-{k % 28 + 1:02d}", "m" if k % 11 else "old", [float(c) for c in x[k]]) for k in range(n)]
    rows += [("a", n + k, "2024-01-05", "m", [float(c) for c in x[1]]) for k in range(70)]  # more equal ones than the list is long
    rows += [("a", 5000 + k, "2024-01-05", "m", [float(k), 1.0]) for k in range(5)] + [("a", 6000, "2024-01-05", "m", [0.0] * dim), ("a", 6001, "2024-01-05", "m", None)]
    df = spark.createDataFrame(rows, CHUNKS).withColumn("vector", F.when(F.col("v").isNotNull(), vectors.quantize(F.col("v"))))
    asked = [(k, rows[k][0], "", rows[k][4], None, None) for k in range(0, n, 37)] + [(2001, "b", "", rows[3][4], None, None), (2002, "nobody", "", rows[3][4], None, None), (2003, "a", "", None, None, None), (2004, "a", "", [1.0, 0.5], None, None), (2005, "a", "", [0.0] * dim, None, None)]
    q = spark.createDataFrame(asked, QUESTIONS)
    some = F.col("qid") % 2 == 0
    return df, q.withColumn("from_day", F.when(some, F.lit("2024-01-03").cast("date"))).withColumn("to_day", F.when(some, F.date_add(F.lit("2024-01-03").cast("date"), (F.col("qid") % 9).cast("int"))))


def plain(df, q, top):
    rows = [(r.owner_id, r.id, r.day, np.array(r.vector.q, np.float64), float(np.float32(r.vector.scale))) for r in df.filter("model = 'm' AND vector IS NOT NULL").collect()]
    out = []
    for r in q.filter("vec IS NOT NULL").collect():
        lo, hi = (str(r.from_day), str(r.to_day)) if r.from_day else ("0", "9")
        v = np.array(r.vec, np.float64)
        scores = sorted((-round(float(v @ x) * s, 6) + 0.0, i) for o, i, d, x, s in rows if o == r.owner_id and len(x) == len(v) and lo <= d <= hi)
        out += [(r.qid, i, k + 1, round(-s, 5)) for k, (s, i) in enumerate(scores[:top])]
    return sorted(out)


@pytest.mark.parametrize("setting", [{}, {"BLOCK": 50, "QUESTIONS": 3}, {"FIRST": 0}, {"CLUSTERS": 1}])
def test_vector_search_equals_all_products(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(vector_index, name, value)
    df, q = corpus(spark)
    got = sorted((r.qid, r.chunk_id, r["rank"], round(r.score, 5)) for r in search.vector_search(q, df, "m", 20).collect())
    assert got == plain(df, q, 20)


def test_scores_are_those_of_rounded_floats(spark):
    # 3/6 of 127 is 63.5 in floats, and a little less in doubles
    df = spark.createDataFrame([("a", 1, "2024-01-05", "m", [0.03, 0.06])], CHUNKS).withColumn("vector", vectors.quantize(F.col("v")))
    q = spark.createDataFrame([(1, "a", "", [1.0, 0.0], None, None)], QUESTIONS)
    assert search.vector_search(q, df, "m").first().score == round(64 * 0.06 / 127, 6)


def test_vector_search_without_rows(spark):
    df, q = corpus(spark)
    assert search.vector_search(q.limit(0), df, "m").count() == 0
    assert search.vector_search(q, df.limit(0), "m").count() == 0
    assert search.vector_search(q, df, "none").count() == 0


def test_clusters_are_pruned_and_bounds_hold(spark):
    df, q = corpus(spark, n=3000, spread=0.05)
    rows = df.filter("vector IS NOT NULL").select("owner_id", F.col("id").alias("chunk_id"), "day", "vector.scale", "vector.q")
    index = vector_index.VectorIndex(rows)
    asked = q.filter("qid < 2000").select("qid", "owner_id", F.lit("0").alias("lo"), F.lit("9").alias("hi"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("dim", F.size("vec"))
    near = index.best(asked, index.opened(asked.withColumn("bound", F.lit(None).cast("double")), 40), 10)
    bound = vector_index.ranked(near, 10).filter("rank = 10").select("qid", F.col("score").alias("bound"))
    sizes = index.rows.groupBy("owner_id", "dim", "cluster").agg(F.count("*").alias("n"))
    opened = index.opened(asked.join(bound, "qid"), None).join(sizes, ["owner_id", "dim", "cluster"])
    looked_at = opened.agg(F.sum("n")).first()[0]
    every = asked.join(rows.groupBy("owner_id").agg(F.count("*").alias("n")), "owner_id").agg(F.sum("n")).first()[0]
    assert looked_at < 0.4 * every
    # no cluster that stays shut has a better chunk
    shut = asked.join(bound, "qid").join(index.rows.withColumnRenamed("dim", "d"), "owner_id").filter("d = dim").join(opened.select("qid", "owner_id", "cluster"), ["qid", "owner_id", "cluster"], "left_anti")
    score = F.aggregate(F.zip_with("vec", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) * F.col("scale")
    assert shut.filter(score > F.col("bound")).isEmpty() and not shut.isEmpty()


# ---- keywords


def diary(spark, seed=5):
    rng = random.Random(seed)
    words = ["встреча", "встретить", "работа", "работать", "кот", "дом", "домой", "x1", "x12", "отчёт", "отчет", "the", "alpha", "alphabet"]
    rows, day_ms = [], 86_400_000
    for k in range(700):
        start = 1_704_067_200_000 + rng.randint(0, 40) * day_ms + rng.choice([0, 0, rng.randint(0, day_ms - 1)])
        text = " ".join(["общее"] * (k % 2) + rng.sample(words, rng.randint(1, 5)))
        rows.append((rng.choice(["o0", "o1"]), k, start, text))
    df = spark.createDataFrame(rows, "owner_id string, id long, start_ms long, text string")
    return df.withColumn("day", F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd")).withColumn("kind", F.lit("TRANSCRIPT"))


def asked(spark):
    rows = [(1, "o0", "общее", None, None), (2, "o1", "общее встреча", None, None), (3, "o0", "работаю дома", "2024-01-05", "2024-01-20"), (4, "o0", "общее кот x1", "2024-01-08", "2024-01-08"), (5, "o1", "отчёты", None, None), (6, "o1", "ничегошеньки", None, None), (7, "o1", "the", None, None), (8, "o9", "общее", None, None), (9, "o0", "общее", None, None), (10, "o0", "alphabets общее", "2024-03-01", "2024-03-02")]
    q = spark.createDataFrame(rows, "qid long, owner_id string, text string, f string, t string")
    return search.question_stems(q.withColumn("from_day", F.to_date("f")).withColumn("to_day", F.to_date("t")))


def keywords_plain(df, q, limit):
    rows = [(r.owner_id, r.id, r.day, r.start_ms, set(r.w)) for r in df.withColumn("w", textops.words(F.col("text"))).collect()]
    out = []
    for r in q.collect():
        lo, hi = r.f or "0", r.t or "9"
        found = [(-s, i, len({x for x in r.stems if any(w.startswith(x) for w in ws)})) for o, i, d, s, ws in rows if o == r.owner_id and lo <= d <= hi]
        out += [(r.qid, i, -s, m) for s, i, m in sorted(x for x in found if x[2])[:limit]]
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 10, 200])
def test_keyword_search(spark, limit):
    df, q = diary(spark), asked(spark)
    got = sorted((r.qid, r.chunk_id, r.start_ms, r.matched) for r in search.keyword_search(q, chunks.build_postings(df), limit).collect())
    assert got == keywords_plain(df, q, limit) and {x[0] for x in got} == {1, 2, 3, 4, 5, 9}


def test_places_of_days_that_cannot_count_are_not_joined(spark):
    df = diary(spark)
    places = df.filter("owner_id = 'o0' AND text LIKE '%общее%'").select("owner_id", F.lit("общ").alias("stem"), F.col("id").alias("chunk_id"), "day", "start_ms").withColumn("block", F.floor(F.col("start_ms") / search.BLOCK_MS))
    asks = spark.createDataFrame([("o0", "общ", "0", "9"), ("o0", "общ", "2024-01-05", "2024-01-06")], "owner_id string, stem string, lo string, hi string")
    kept = search.newest_blocks(asks, places, 10)
    of_all = kept.filter("lo = '0'").join(places, ["owner_id", "stem", "block"])
    per_day = places.groupBy("block").count().agg(F.max("count")).first()[0]
    assert 10 <= of_all.count() < 10 + per_day < places.count()
    assert {r.block for r in kept.filter("lo > '0'").collect()} <= {1_704_067_200_000 // search.BLOCK_MS + d for d in (4, 5)}


# ---- hybrid search and contexts

DIM = 8


def mixed_diary(spark):
    """Transcripts with vectors of two models, and a digest for two days of three."""
    rng = np.random.default_rng(9)
    t = diary(spark).select("owner_id", "id", "day", "kind", "start_ms", F.col("start_ms").alias("end_ms"), "text")
    days = t.select("owner_id", "day").distinct().filter(F.dayofmonth(F.to_date("day")) % 3 != 0)
    digest = days.select("owner_id", (F.lit(100_000) + F.crc32(F.concat("owner_id", "day").cast("binary"))).alias("id"), "day", F.lit("DAY").alias("kind"), F.unix_millis(F.to_timestamp("day")).alias("start_ms"), F.unix_millis(F.to_timestamp("day")).alias("end_ms"), F.concat(F.lit("Итог дня: общее "), "day").alias("text"))
    rows = t.unionByName(digest).orderBy("id").collect()
    vecs = spark.createDataFrame([(r.id, [float(x) for x in rng.normal(0, 1, DIM)], "m" if r.id % 5 else "old") for r in rows], "id long, v array<float>, model string")
    return t.unionByName(digest).join(vecs, "id").withColumn("vector", vectors.quantize(F.col("v")))


def hybrid_plain(every, questions, limit=12):
    rows = [(r, set(r.w), np.array(r.vector.q, np.float64), float(np.float32(r.vector.scale))) for r in every.withColumn("w", textops.words(F.col("text"))).collect()]
    out = []
    for q in questions.collect():
        mine = [x for x in rows if x[0].owner_id == q.owner_id]

        def lists(lo, hi, q=q, mine=mine):
            inside = [x for x in mine if lo <= x[0].day <= hi]
            hits = [(r, len({s for s in q.stems if any(w.startswith(s) for w in ws)})) for r, ws, _, _ in inside]
            hits = sorted((h for h in hits if h[1]), key=lambda h: (-h[0].start_ms, h[0].id))[:200]
            text = [r.id for r, _ in sorted(hits, key=lambda h: (-h[1], -h[0].start_ms, h[0].id))][:30]
            near = []
            if q.vec is not None:
                v = np.array(q.vec, np.float64)
                near = [i for _, i in sorted((-round(float(v @ x) * s, 6), r.id) for r, _, x, s in inside if r.model == "m")][:30]
            seen = {}
            for k, ids in enumerate((text, near)):
                for rank, i in enumerate(ids, 1):
                    seen.setdefault(i, []).append((k, rank))
            fused = sorted(((-round(sum(1 / (60 + r) for _, r in at), 9), min(at), i) for i, at in seen.items()))[:limit]
            return [(i, -s, any(k == 0 for k, _ in seen[i]), any(k == 1 for k, _ in seen[i])) for s, _, i in fused]

        if q.f is None:
            found = lists("0", "9")
        else:
            found = lists(q.f, q.t)
            if len(found) < 3:
                found = (found + [x for x in lists("0", "9") if x[0] not in {y[0] for y in found}])[:limit]
            last = min(q.t, str(np.datetime64(q.f) + 13))
            front = sorted((r.day, r.id) for r, *_ in mine if r.kind == "DAY" and q.f <= r.day <= last)
            found = [(i, 1.0, False, False) for _, i in front if i not in {x[0] for x in found}] + found
        out += [(q.qid, n, *x) for n, x in enumerate(found, 1)]
    return sorted(out)


def with_vectors(spark):
    rng = np.random.default_rng(4)
    q = asked(spark)
    vecs = spark.createDataFrame([(r.qid, [float(x) for x in rng.normal(0, 1, DIM)] if r.qid != 5 else None) for r in q.select("qid").orderBy("qid").collect()], "qid long, vec array<float>")
    return q.join(vecs, "qid")


def test_hybrid_search_equals_the_plain_one(spark):
    every, q = mixed_diary(spark).cache(), with_vectors(spark).cache()
    got = search.hybrid_search(q, every, chunks.build_postings(every), "m")
    rows = sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9), r.via_text, r.via_vector) for r in got.collect())
    expected = [(a, b, c, round(d, 9), e, f) for a, b, c, d, e, f in hybrid_plain(every, q)]
    assert rows == expected
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert max(map(len, by.values())) > 12 and any(r[4] and r[5] for r in rows) and not any(r[5] for r in by[5])
    # nothing in March: filled up with hits of any day
    assert [r[3] < 1 for r in by[10]] == [True] * 12


def test_contexts_equal_the_plain_fold(spark):
    from daybook.operators import context

    every, q = mixed_diary(spark).cache(), with_vectors(spark).withColumn("today", F.lit("2024-02-12").cast("date")).cache()
    long = every.withColumn("text", F.expr("array_join(transform(sequence(1, 1 + id % 60), k -> concat(text, ' ', k)), ' ')"))
    hits = search.hybrid_search(q, every, chunks.build_postings(every), "m").join(long.withColumnRenamed("id", "chunk_id"), "chunk_id").withColumnRenamed("chunk_id", "id").cache()
    labels = {r.id: r.label for r in context.source_labels(long, "UTC").collect()}
    for budget in (60, 200, 900):
        got = {r.qid: r for r in context.build_contexts(q, hits, budget, "UTC").collect()}
        for r in q.collect():
            user = got[r.qid].user_prompt
            header, footer = user[: user.index("Фрагменты дневника:\n") + 20], user[user.index("\n\nВопрос: ") :]
            room, picked = budget - len(header.split()) - len(footer.split()), []
            for h in sorted((h for h in hits.collect() if h.qid == r.qid), key=lambda h: h["rank"]):
                cost = len(h.text.split()) + context.HIT_COST
                if room <= context.STOP_AT:
                    break
                if cost <= room:
                    picked.append((h.day, h.start_ms, h.kind != "DAY", h["rank"], h.id, h.text))
                    room -= cost
                elif room >= cost // 3:
                    cut = h.text[: max(1, int(len(h.text) * (room - context.HIT_COST) / (cost - context.HIT_COST)))]
                    picked.append((h.day, h.start_ms, h.kind != "DAY", h["rank"], h.id, (cut[: cut.rindex(" ")] if " " in cut else cut) + " …"))
                    room = 0
            picked.sort()
            assert [(s.n, s.chunk_id, s.label) for s in got[r.qid].sources] == [(k, p[4], labels[p[4]]) for k, p in enumerate(picked, 1)], (budget, r.qid)
            body = "".join(f"[{k}] ({labels[p[4]]})\n{p[5]}\n\n" for k, p in enumerate(picked, 1)) or context.NOTHING
            assert user == header + body + footer
