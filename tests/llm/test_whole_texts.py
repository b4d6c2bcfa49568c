"""Nothing is left out of a fit for its length, or of a comparison for being common."""

import random

from pyspark.sql import functions as F

from daybook.llm import near_copies, toxicity


def test_long_labelled_texts_are_learnt_from(spark):
    filler = " ".join(f"plain{k % 400}" for k in range(5000))
    rows = [(k, f"{filler} {'vile' if k % 2 else 'kind'} words{k % 7} {'vile' if k % 2 else 'kind'}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.select(F.min(F.octet_length("text"))).first()[0] > 30_000
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).filter("held_out").collect()
    right = sum(r.predicted == r.doc_id % 2 for r in got)
    assert len(got) > 20 and right >= 0.9 * len(got)
    # without a word on the long texts, nothing tells the two kinds apart
    none = toxicity.toxicity(docs, labels.filter("doc_id < 0")).select("score").distinct().collect()
    assert len(none) == 1


def jaccard_groups(texts):
    """The smallest doc_id that links of a Jaccard similarity of 0.8 reach, over five-word shingles."""
    sets = {}
    for d, t in texts:
        w = t.lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared * 5 >= (len(sets[a]) + len(sets[b]) - shared) * 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_a_shingle_of_a_third_of_all_documents(spark, monkeypatch):
    rng = random.Random(2)
    own = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = "this very common passage stands in many a document of ours".split()
    texts = []
    for k in range(240):
        words = own(rng.choice([0, 3, 12, 40]))
        texts.append([*passage, *words] if k % 3 == 0 else [*own(30), *words])
    for k in range(60):  # near copies of others
        base = list(texts[rng.randrange(240)])
        base[rng.randrange(len(base))] = "changed"
        texts.append(base)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    expected = jaccard_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # counters that are full tell nothing of how rare a shingle is, and nearly every token counts as hot
    for counters, share in ((near_copies.COUNTERS, near_copies.HOT_SHARE), (16, 40), (16, 10**6)):
        monkeypatch.setattr(near_copies, "COUNTERS", counters)
        monkeypatch.setattr(near_copies, "HOT_SHARE", share)
        assert {r.doc_id: r.component_id for r in near_copies.near_groups(df).collect()} == expected


def test_rows_of_hot_tokens_meet_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7 if k % 3 else k, k, rng.randint(20, 60), 0, k) for k in range(300)]
    df = spark.createDataFrame(rows, "token long, node long, n int, place int, root long")
    every = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    close = {p for p in every if 5 * min(rows[p[0]][2], rows[p[1]][2]) >= 4 * max(rows[p[0]][2], rows[p[1]][2])}
    monkeypatch.setattr(near_copies, "HOT_SHARE", 1)
    assert sorted((r.node, r.leader.node) for r in near_copies._met(df).collect()) == sorted(every)
    monkeypatch.setattr(near_copies, "HOT_SHARE", 30)
    met = near_copies._met(df)
    got = [(r.node, r.leader.node) for r in met.collect()]
    assert len(set(got)) == len(got) and close <= set(got) < every
    assert len({(r.step, r.part) for r in met.filter("token = 7").select("step", "part").distinct().collect()}) > 40
