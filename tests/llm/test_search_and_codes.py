"""Ranked search, vector codes and exact top-k against plain versions, on awkward rows and with blocks, slices and groups small enough to meet."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from daybook.llm import ranked_search, top_products, vector_codes

NAMES = "rank score item_id term bundle slice at who items terms owner n block asked part x codes distances label_error query candidate cutoff h first dim hot cold"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))


# ---- ranked search


def ranked_plain(docs, items, top):
    found = [(d, terms(t)) for d, t in docs if d is not None and t is not None]
    found = [(d, w) for d, w in found if w]
    n_docs, places = len(found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = {}
    for i, text in items:
        if i is not None and terms(text):
            asked.setdefault(i, set()).update(terms(text))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, w in found:
            m, tf = 100 - 50 + (50 * len(w) * n_docs) // places, Counter(w)
            score = sum(weight[t] * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in wanted if t in tf)
            if score > 0:
                scores.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def ranked_rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["ÀÉ", "日本", "été", "MIT", "mit"]
    say = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 64)] for _ in range(n))
    docs = [(k, say(rng.choice([1, 5, 40, 200]))) for k in range(150)]
    docs += [(k, "Hot! hot, HOT words") for k in range(150, 200)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1"), (300, None), (301, ""), (302, " \n ,"), (303, "a" * 5000 + " w3"), (304, "Kelvin K sign w2")]
    items = [(k, say(8)) for k in range(12)] + [(50, "hot WORDS"), (51, "unknown"), (52, None), (53, ""), (None, "w1"), (3, "w9 w10"), (54, "w1 w1 w1"), (55, "K k"), (56, say(60))]
    return docs, items


@pytest.mark.parametrize("setting", ["plain", "slices", "groups"])
def test_ranked_search(spark, monkeypatch, setting):
    docs, items = ranked_rows()
    top, limit = 7, ranked_search.VOCABULARY_BYTES
    if setting == "slices":
        monkeypatch.setattr(ranked_search, "SLICE_DOCS", 16)
        monkeypatch.setattr(ranked_search, "BUNDLE_ITEMS", 4)
    if setting == "groups":
        limit = 6000
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", *[f"'own' AS {c}" for c in NAMES.split()])
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", ranked_search.F.lit("clash"))
    got = sorted(tuple(r) for r in ranked_search.ranked_search(d, i, top, limit).collect())
    assert got == ranked_plain(docs, items, top)
    assert any(x[0] == 50 and x[2] == 150 and x[1] == 1 for x in got)
    if setting == "plain":
        assert ranked_search.ranked_search(d.limit(0), i, top).count() == 0
        assert ranked_search.ranked_search(d, i.limit(0), top).count() == 0


def test_terms_of_long_texts_are_whole_at_every_stretch():
    text = ("Alpha, betaé gamma7 " * 300 + "x" * 500 + " end").encode()
    whole = text.translate(ranked_search._SPACED).split()
    for stretch in (1, 7, 64, 1000, 1 << 20):
        assert [t for part in ranked_search._terms(text, stretch) for t in part] == whole


# ---- vector codes


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def codes_plain(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((v, lab, [math.floor(4096 * x) for x in vec]) for v, lab, vec in rows if usable(vec)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    dim = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == dim]
    cut = [dim * p // parts for p in range(parts + 1)]
    piece = lambda x, p: x[cut[p] : cut[p + 1]]
    books = [[piece(r[2], p) for r in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(piece(r[2], p), books[p])[1] for r in kept]
            new = []
            for k, e in enumerate(books[p]):
                mine = [piece(r[2], p) for r, o in zip(kept, of, strict=True) if o == k]
                new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine and e else e)
            books[p] = new
    final = [[near(piece(r[2], p), books[p]) for p in range(parts)] for r in kept]
    error = [sum(d for d, _ in f) for f in final]
    by = Counter()
    for r, e in zip(kept, error, strict=True):
        by[r[1]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[1]], sha) for r, f, e in zip(kept, final, error, strict=True)]


def vector_rows(n=300, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (5, dim))
    rows = [(k, [0, 1, 2, None][k % 4], (centres[k % 5] + rng.normal(0, 0.05, dim)).astype(np.float32).tolist()) for k in range(n)]
    same = rows[0][2]
    rows += [(n + k, 9, same) for k in range(60)] + [(5, 1, rows[6][2]), (5, 1, rows[6][2]), (None, 1, rows[7][2])]
    return rows + [(900, 1, None), (901, 1, [0.1] * (dim - 1) + [None]), (902, 1, [float("nan")] * dim), (903, 1, [float("-inf")] + [0.0] * (dim - 1)), (904, 1, [0.5] * (dim + 8)), (905, 1, [])]


VECTORS = "vec_id long, label int, embedding array<float>"
by_text = lambda rows: sorted(rows, key=str)


@pytest.mark.parametrize("case", [{}, {"dim": 24}, {"n": 11, "dim": 8}, {"dim": 13}])
def test_vector_codes(spark, case):
    rows = vector_rows(**case)
    df = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", *[f"'own' AS {c}" for c in NAMES.split()])
    got = vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert by_text(tuple(r) for r in got.collect()) == by_text(codes_plain(rows))


def test_vector_codes_of_few_or_no_rows(spark):
    df = spark.createDataFrame(vector_rows(), VECTORS)
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    assert vector_codes.vector_codes(df.filter("vec_id >= 900 AND vec_id < 904")).count() == 0
    one = [(3, None, [0.25] * 8)]
    assert [r.code for r in vector_codes.vector_codes(spark.createDataFrame(one, VECTORS)).collect()] == ["00" * 8]
    empty = spark.createDataFrame([(1, 1, []), (2, 1, [])], VECTORS)
    assert [(r.code, r.error) for r in vector_codes.vector_codes(empty).collect()] == [("00" * 8, 0)] * 2


def test_rare_and_hot_labels_have_their_sums(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"rare {k // 30}", k) for k in range(300)] + [(k, None, 1) for k in range(5)], "vec_id long, label string, error long")
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 10)
    expected = {r.label: r.s for r in rows.groupBy("label").agg(vector_codes.F.sum("error").alias("s")).collect()}
    got = vector_codes._with_label_errors(rows).collect()
    assert len(got) == 305 and all(r.label_error == expected[r.label] for r in got)


def test_only_moved_entries_are_compared():
    rng = np.random.default_rng(1)
    x, entries = rng.integers(-9, 9, (2000, 3)), rng.integers(-9, 9, (16, 3))
    plain = lambda e: (vector_codes._squared(x, e).argmin(axis=1), vector_codes._squared(x, e).min(axis=1))
    code, distance, n = vector_codes.assign(x, entries, np.ones(16, bool), np.full(2000, -1), np.zeros(2000, np.int64))
    assert (code == plain(entries)[0]).all() and n == 2000 * 16
    for _ in range(30):
        moved = rng.random(16) < 0.2
        new = np.where(moved[:, None], rng.integers(-9, 9, (16, 3)), entries)
        again, d, n = vector_codes.assign(x, new, moved, code, distance)
        assert (again == plain(new)[0]).all() and (d == plain(new)[1]).all()
        rescans = int(moved[code].sum())
        assert n == rescans * 16 + (2000 - rescans) * int(moved.sum()) < 2000 * 16
        entries, code, distance = new, again, d


# ---- exact top-k


def products_plain(rows, every, top):
    best = {}
    for v, _, vec in rows:
        if v is not None and usable(vec):
            x = [math.floor(1024 * c) for c in vec]
            best[v] = min(best.get(v, x), x)
    out = []
    for q, x in best.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in best.items() if v != q and len(y) == len(x))
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:top])]
    return sorted(out)


@pytest.mark.parametrize("setting", [{}, {"block": 64, "queries": 7}, {"slices": 4}, {"slices": 1}, {"top": 1}, {"top": 400}])
def test_top_products(spark, setting):
    rows = vector_rows() + [(k, 1, [0.0] * 16) for k in range(1000, 1030)] + [(k, 2, [-0.5] * 16) for k in range(1100, 1120)] + [(1200, 1, []), (1201, 1, [])]
    df = spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", *[f"'own' AS {c}" for c in NAMES.split()])
    got = top_products.top_products(df, every=10, **setting)
    assert sorted(tuple(r) for r in got.collect()) == products_plain(rows, 10, setting.get("top", 10))


def test_top_products_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(100, 1, [1.0, 2.0])], VECTORS)
    assert top_products.top_products(df).count() == 0
    assert top_products.top_products(df.limit(0)).count() == 0


def test_the_cutoff_spares_most_products(spark):
    rng = np.random.default_rng(5)
    rows = [(k, 1, rng.normal(0, 0.125, 16).astype(np.float32).tolist()) for k in range(4000)]
    grid = top_products._Grid(top_products._numbered(spark.createDataFrame(rows, VECTORS), "embedding", 1024, 100, 10), 2, 1024, 64)
    lists = top_products._resolved(grid, top_products._sums(top_products._local_lists(grid.nodes(), 2, 10), 2))
    cuts = top_products._kth(lists, 10).selectExpr("qid", "dim", "kth div 2 AS cutoff")
    collected = top_products._sufficient(grid.with_cutoffs(cuts), 2).count()
    assert 0 < collected < 0.1 * 2 * 40 * 4000
