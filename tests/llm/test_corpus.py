"""Each corpus operator against a plain version of itself, on small rows with every awkward case."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import exact_dedup, fingerprint, graph, license_scan, line_dedup, lm_scoring, mixing, near_copies, sentencepiece_sampling, simhash, token_counts, toxicity
from daybook.llm import queries as registered
from daybook.llm.common import LOWER_AZ

DOCS = "doc_id long, text string, lang string, source string, n_chars long, members string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = say(80)
    return [None, "", "  \n ", "ÀÉ été", "Copy THIS", "copy this", "COPY this", base, base.upper(), base + " extra", base, say(300), "x" * 5000, "ja 日本語 😀 text", say(3), say(40) + "\n" + say(40), "a▁b  c\r\n\td", "The MIT License and the mit license", say(2000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", "c", None][k % 4], len(t or ""), "clash") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return (t or "").encode().translate(LOWER_AZ)


# ---- exact deduplication


def test_exact_dedup(docs, none):
    groups = defaultdict(list)
    for k, t in enumerate(texts()):
        groups[low(t)].append(k)
    expected = {(k, max(g), len(g), k == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for k in g}
    for limit in (exact_dedup.TABLE_BYTES, 600):  # the second one has to spill
        assert {tuple(r) for r in exact_dedup.exact_dedup(docs, limit).collect()} == expected
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "A"), (None, "a")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(df).collect()) == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True)]


def test_table_compares_contents_when_hashes_are_equal():
    table = exact_dedup.ContentTable()
    assert [table.place(7, c) for c in (b"a", b"b", b"a")] == [0, 1, 0]
    assert [table.place(k, str(k).encode()) for k in range(3000)] == list(range(2, 3002))


def test_a_content_that_all_rows_share_takes_bounded_memory(spark):
    import tracemalloc

    content = b"the same words in every row " * 40

    def records(n):
        for k in range(n):
            h = 5 if k % 100 else k
            yield h, content if k % 100 else b"own %d" % k, k, 1, exact_dedup.array("q", [k])

    tracemalloc.start()
    rows = 0
    for batch in exact_dedup._grace(records(120_000), 0, 100_000):
        rows += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 1.2 kB a row would be 140 MB
    assert rows == 120_000 and peak < 12_000_000
    same = spark.range(30_000).selectExpr("id AS doc_id", "repeat('Copy ', 50) AS text").unionByName(spark.createDataFrame([(-1, None)], "doc_id long, text string"))
    got = exact_dedup.exact_dedup(same, 20_000)
    assert [tuple(r) for r in got.groupBy("keep_id", "group_size").count().orderBy("keep_id").collect()] == [(-1, 1, 1), (29_999, 30_000, 30_000)] and got.filter("kept").count() == 2


# ---- SimHash


def plain_fingerprint(t):
    words = low(t).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(points, near):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(points):
        for b in points[k + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


def test_simhash(docs, none):
    fp = {k: plain_fingerprint(t) for k, t in enumerate(texts())}
    comp = reachable(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert got == {(k, f"{v:016x}", comp[k]) for k, v in fp.items()}
    assert simhash.simhash_groups(none).count() == 0


@pytest.mark.parametrize("block", [1500, 20])
def test_links_find_every_component(spark, block):
    rng = random.Random(block)
    points = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        points.add(p)
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 6)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    crowd = rng.getrandbits(64)  # a dense group: all within few bits of one point
    points |= {crowd ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    expected = reachable(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    placed = {r.node: r.root for r in graph.components(simhash.links(df, 4, block)).collect()}
    assert {p: placed.get(p, p) for p in signed} == expected


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thresholds_sum_to_the_pigeonhole_bound():
    estimates = [[10.0 * (k + 1) * (j + 1) for j in range(5)] for k in range(4)]
    _, t = simhash.allocate(estimates, [16] * 4, 1000, 4)
    assert sum(t) == 4 - 4 + 1 and min(t) >= -1


# ---- near copies by shingles


def test_shingle_sets_and_fingerprints_follow_their_definition():
    made = [low(t) for t in texts()]
    hashes, ends = near_copies.shingle_sets(made)
    fps = near_copies._fingerprints(hashes, ends).tolist()
    seen = {}
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        words = made[k].split()
        plain = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        mine = hashes[a:b].tolist()
        assert len(mine) == len(plain) and mine == sorted(set(mine))
        assert seen.setdefault(frozenset(plain), mine) == mine
        assert fps[k] == sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in mine) > len(mine))
    assert near_copies.shingle_sets([])[1].tolist() == [] and near_copies.shingle_sets([b"", b" "])[1].tolist() == [0, 0]


def test_near_copies_are_the_groups_of_all_pairs(spark):
    rng = random.Random(11)
    made = list(texts())
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        made.append(" ".join(words))
        for _ in range(rng.randrange(8)):
            near = list(words)
            for _ in range(rng.randrange(1, max(2, len(words) // 25))):
                near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
            made.append(" ".join(near))
    passage = " ".join(f"p{k}" for k in range(30))
    made += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    rng.shuffle(made)
    sets = {}
    for k, t in enumerate(made):
        words = low(t).split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    expected = reachable(list(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == {k for k, v in expected.items() if k == v}


# ---- lines


def test_line_dedup(spark):
    line, short = "a boilerplate line that many sites have", "short one"
    rows = [(k, f"own text number {k} of this document\n{line}\n{short}", f"s{k}") for k in range(7)] + [(7, None, "s0"), (8, "", None), (9, f"{line}\n{line}", "s0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert len(got) == 10 and got[0].n_removed == 0 and got[0].text == rows[0][1]
    assert all(got[k].text == f"own text number {k} of this document\n{short}" and got[k].n_removed == 1 for k in range(1, 7))
    assert got[7].text is None and got[8].text == "" and got[9].text == "" and got[9].n_removed == 2
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_lines_around_the_threshold_are_counted_exactly(spark):
    rows = [(100 * n + k, f"a line that stands on {n} sites", f"s{k}") for n in (3, 4, 5, 6, 7) for k in range(n)]
    found = line_dedup.boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5, 20)
    assert found.count() == 3


# ---- licences


def test_license_scan(spark, docs, none):
    import re

    base = license_scan.BASE
    extra = ["Licensed under the Apache License, Version 2.0.", "GNU general public license; gnu GENERAL public license", "apache, license cc-by mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this fine software", "mit license " * 30, "bananas cc by-nc", "gnu general license"]
    rows = list(enumerate([*texts(), *extra]))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, pair string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    for k, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t).decode())
        places = sorted((i, label) for phrase, label in base.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
        r = got[k]
        assert (r.n_words, r.n_base) == (len(words), len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "apache-2.0" in got[len(texts())].labels and "mit-text" in got[len(texts()) + 3].labels
    assert license_scan.license_scan(none).count() == 0


# ---- fingerprints


def test_fingerprints(spark, docs, none):
    got = {r.doc_id: r for r in fingerprint.fingerprint(docs, 3000).collect()}
    one = {r.doc_id: r for r in fingerprint.fingerprint(docs).collect()}
    assert got == one and len(got) == len(texts())
    order = sorted(got, reverse=True)
    for at, k in enumerate(order):
        t, following = texts()[k] or "", texts()[order[(at + 1) % len(order)]] or ""
        cut = len(t) // 3
        changed = t[: len(t) - cut] + following[:cut]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[7].fingerprint == got[10].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert got[18].near_edited > 0.5 > got[18].near_next
    assert fingerprint.fingerprint(none).count() == 0


def plain_digest(hashes):
    """Filters as sets of bits."""
    distinct, filters = list(dict.fromkeys(int(h) for h in hashes)), []
    for k, h in enumerate(distinct):
        if k % fingerprint.FEATURES == 0:
            filters.append(set())
        filters[-1] |= {h >> 11 * j & fingerprint.FILTER_BITS - 1 for j in range(fingerprint.HASHES)}
    return filters


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        best = 0.0
        for y in b:
            chance, most = len(x) * len(y) / fingerprint.FILTER_BITS, min(len(x), len(y))
            if most > chance:
                best = max(best, (len(x & y) - chance) / (most - chance))
        total += best * len(x)
    ones = sum(map(len, a))
    return min(1.0, max(0.0, total / ones)) * min(1.0, 1.5 * ones / sum(map(len, b)))


def test_digests_and_likeness_follow_their_definition():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    for n, m, shared in ((0, 0, 0), (0, 5, 0), (1, 1, 1), (40, 45, 30), (128, 128, 128), (300, 120, 100), (290, 310, 250)):
        a, b = pool[:n], np.concatenate([pool[:shared], pool[300 : 300 + m - shared]])
        a = np.concatenate([a, a[:3]])  # repeats count once
        x, y = fingerprint.digest(a), fingerprint.digest(b)
        for made, plain in ((x, plain_digest(a)), (y, plain_digest(b))):
            assert [{64 * w + j for w in range(len(f)) for j in range(64) if int(f[w]) >> j & 1} for f in made] == plain
        if len(x) != len(y) or n == m:
            assert abs(fingerprint.likeness(x, y) - plain_likeness(plain_digest(a), plain_digest(b))) < 1e-9
        assert fingerprint.likeness(x, y) == fingerprint.likeness(y, x) and fingerprint.likeness(x, x) > 0.999


def test_entropy_and_selection_follow_their_definition():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abcdefgh \n" if k % 300 < 250 else b"z") for k in range(1500))
    found = fingerprint.entropy_classes(np.frombuffer(data, np.uint8))
    top = int(fingerprint._F[64])
    for i in range(0, len(data) - 63, 7):
        total = sum(int(fingerprint._F[n]) for n in Counter(data[i : i + 64]).values())
        assert found[i] == min(255, (top - total) * 256 // (top + 1))
    rank = fingerprint.rarity(np.bincount(found, minlength=256))
    alone = fingerprint.features([data], rank)[0]
    assert all(np.array_equal(alone, f) for f in fingerprint.features([b"", data, b"ab", data], rank)[1::2])
    wins = Counter()
    for i in range(len(found) - 63):
        wins[min(range(i, i + 64), key=lambda j: (rank[found[j]], j))] += 1
    assert len(alone) == sum(n >= 16 for n in wins.values())


def test_features_of_a_text_do_not_depend_on_its_size():
    rng = random.Random(6)
    data = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)).encode()
    rank = fingerprint.rarity(fingerprint.class_counts([data]))
    for a, b in ((1023, 1025), (141, 145), (300, 302)):
        first, second = (fingerprint.features([data[:n]], rank)[0] for n in (a, b))
        assert abs(len(first) - len(second)) <= 2 and set(first) & set(second)
        assert a < 1000 or fingerprint.likeness(fingerprint.digest(first), fingerprint.digest(second)) > 0.8
    for n in (64, 100, 126, 127, 141):  # each window of the text is found alone as among others
        alone = fingerprint.features([data[:n]], rank)[0]
        assert len(alone) and all(np.array_equal(alone, f) for f in fingerprint.features([b"x" * 200, data[:n], b"", data[:n]], rank)[1::2])
        assert len(alone) <= n - 63


# ---- token counts


def test_edits_count_as_a_full_encoding_would(spark, docs):
    got = {r.doc_id: r for r in token_counts.count_edited(docs, registered.derived_edits(), return_text=True).collect()}
    whole = token_counts.Counter(token_counts.VOCABULARY).encoding
    for k, t in enumerate(texts()):
        t = t or ""
        r = got[k]
        n = len(t)
        s = t
        for start, length, new in ((n // 3, 40, t[:60]), (2 * n // 3, 25, ""), (n + 1000, 0, " " + t[4:34])):
            start = min(start, len(s))
            s = s[:start] + new + s[start + length :]
        assert r.edited_text == s and r.n_tokens == len(whole.encode_ordinary(t)) and r.edited_tokens == len(whole.encode_ordinary(s))
    odd = spark.createDataFrame([(1, "ab", [None, (None, None, None), (-5, 1, "x")]), (2, None, None)], "doc_id long, text string, edits array<struct<start: long, length: long, replacement: string>>")
    assert [r.edited_text for r in token_counts.count_edited(odd, return_text=True).orderBy("doc_id").collect()] == ["xb", ""]


def test_random_edits():
    counter, rng = token_counts.Counter(token_counts.VOCABULARY), random.Random(9)
    parts = ["a", " ", "\n", "'", "s", "ll", "  ", "é", "1", "!", "\t", "word", "'re", "\n\n", " x", "日"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(250)))
        tree = token_counts.EditTree(text, counter)
        for _ in range(4):
            start, length, new = rng.randrange(len(text) + 1), rng.randrange(10), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 500])))
            tree.edit(start, length, new)
            text = text[:start] + new + text[start + length :]
        assert tree.text == text and tree.tokens == len(counter.encoding.encode_ordinary(text)) and tree.pretokens == len(counter.pattern.findall(text))


# ---- segmentations


def test_segmentations(docs, none):
    rows = sentencepiece_sampling.sample_segmentations(docs, samples=3, return_ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(range(len(texts())))
    for k, found in by.items():
        assert all(r.round_trip for r in found) and len({tuple(r.ids) for r in found}) == len(found)
        assert [r.perturbed for r in sorted(found, key=lambda r: r.sample)] == sorted((r.perturbed for r in found), reverse=True)
        assert all(r.log_inclusion <= 1e-9 and r.log_prob <= 1e-6 for r in found)
    assert by[1][0].n_pieces == 0 and len(by[1]) == 1
    again = sentencepiece_sampling.sample_segmentations(docs.repartition(3), samples=3, return_ids=True).collect()
    assert sorted(again) == sorted(rows)
    assert sentencepiece_sampling.sample_segmentations(none).count() == 0


def test_samples_are_drawn_without_replacement_by_their_probability():
    sampler = sentencepiece_sampling.Sampler(samples=3)
    every = sentencepiece_sampling.Sampler(samples=100).sample([0], ["the on"])[0]
    p = {tuple(ids): math.exp(logp) for ids, logp, _, _ in every}
    assert len(p) == 32 and abs(sum(p.values()) - 1) < 1e-4
    n = 6000
    first, second = Counter(), Counter()
    for f in sampler.sample(list(range(n)), ["the on"] * n):
        first[tuple(f[0][0])] += 1
        second[tuple(f[1][0])] += 1
    for ids, q in p.items():
        after = sum(p[o] * q / (1 - p[o]) for o in p if o != ids)
        assert abs(first[ids] / n - q) < 0.03 and abs(second[ids] / n - after) < 0.03


def test_lattices_give_every_segmentation_its_share():
    """Against all segmentations by hand: probabilities of units of every kind, also beyond what a float's range allows at once."""
    sampler = sentencepiece_sampling.Sampler(samples=3000)
    pieces = sampler.pieces
    for text in ("on", "the one", "été", "日x", "a\n\nb", "  ab"):
        units = sentencepiece_sampling.UNITS.findall((" " + text).replace(" ", sentencepiece_sampling.SPACE))
        expected = {(): 0.0}
        for unit in units:
            ways = [[] for _ in unit] + [[((), 0.0)]]
            for k in range(len(unit) - 1, -1, -1):
                for end in range(k + 1, len(unit) + 1):
                    ids = [i for i, raw in enumerate(pieces.raw) if i not in pieces.byte_of and raw == unit[k:end].replace(sentencepiece_sampling.SPACE, " ").encode() and i > 2]
                    if not ids and end == k + 1:
                        ids = [tuple(pieces.id_of_byte[b] for b in unit[k].encode())]
                    for i in ids:
                        i = i if isinstance(i, tuple) else (i,)
                        ways[k] += [(i + rest, sum(pieces.weight[x] for x in i) + w) for rest, w in ways[end]]
            total = math.log(sum(math.exp(w) for _, w in ways[0]))
            expected = {a + b: v + w - total for a, v in expected.items() for b, w in ways[0]}
        found = {tuple(ids.tolist()): logp for ids, logp, _, _ in sampler.sample([3], [text])[0]}
        assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found), text
    few = sentencepiece_sampling.Sampler(samples=2)
    for text in ("日" * 3000, "x" * 3000, "ab" * 2000 + " 日本"):
        found = few.sample([1], [text])[0]
        assert len({tuple(ids) for ids, *_ in found}) == len(found) >= 1 + ("x" in text or "b" in text)
        assert all(few.pieces.decode(ids) == text.encode() and -1e6 < logp <= 0 and inclusion <= 0 for ids, logp, _, inclusion in found)


def test_inclusion_scores_weigh_samples_without_bias():
    """Over many keys, each sample weighed by its probability over its inclusion gives back the mean over all segmentations."""
    every = sentencepiece_sampling.Sampler(samples=100).sample([0], ["the on"])[0]
    mean = sum(math.exp(logp) * len(ids) for ids, logp, _, _ in every)
    assert all(inclusion == 0 for *_, inclusion in every)
    n = 6000
    drawn = sentencepiece_sampling.Sampler(samples=3).sample(list(range(n)), ["the on"] * n)
    weighed = sum(math.exp(logp - inclusion) * len(ids) for found in drawn for ids, logp, _, inclusion in found) / n
    ones = sum(math.exp(logp - inclusion) for found in drawn for _, logp, _, inclusion in found) / n
    assert abs(ones - 1) < 0.03 and abs(weighed / mean - 1) < 0.03


# ---- toxicity


def labelled_rows(n=1500):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        words = [rng.choice(WORDS) + rng.choice("abc") for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for bad in ("vile", "foul", "nasty")[: rng.randrange(1, 4)]:
                words.insert(rng.randrange(len(words)), bad)
        rows.append((k, " ".join(words), "en" if k % 2 else "fr", int(toxic)))
    return rows


def test_toxicity_learns_and_leaves_the_fold_out(spark, none):
    rows = labelled_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    docs, labels = df.select("doc_id", "text", "lang", "score"), df.selectExpr("doc_id", "score AS toxic")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[k].predicted == y for k, _, _, y in held) / len(held) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()} == {k: r.score for k, r in got.items()}
    assert toxicity.toxicity(none, labels).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert len({r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()}) == 1


def test_scores_are_a_plain_forward_pass_and_thresholds_shrink():
    rows = labelled_rows(900)
    net = toxicity.train([t.encode() for _, t, _, _ in rows], np.array([y for *_, y in rows]), [lang if k % 50 != 4 else "xx" for k, _, lang, _ in rows])
    odd = [b"", b"one", "été vile ÀB".encode(), b"x " * 500]
    z = toxicity._logits(net, [toxicity.buckets_of(t) for t in [r[1].encode() for r in rows[:40]] + odd], toxicity._tables(net))
    for text, found in zip([r[1].encode() for r in rows[:40]] + odd, z, strict=True):
        words = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in text).split()
        both = [(net.rows[zlib.crc32(w) & toxicity.BUCKETS - 1], net.rows[zlib.crc32(w[: toxicity.STEM], 1) & toxicity.BUCKETS - 1]) for w in words] + [(0, 0)] * 4
        x = np.array([net.embed[a].astype(float) + net.embed[b] for a, b in both])
        pooled = []
        for width in toxicity.WIDTHS:
            h = np.array([sum(x[i + o] @ net.filters[width, o] for o in range(width)) for i in range(max(1, len(words)))])
            pooled += h.max(0).tolist()
        expected = np.maximum(np.array(pooled) + net.bias, 0) @ net.out[:-1] + net.out[-1]
        assert abs(found - expected) < 1e-3
    # few toxic rows leave a language near the threshold of all
    assert set(net.thresholds) == {"en", "fr", "xx"} and abs(net.thresholds["xx"] - 0.5) < 0.5 * 20 / 21


def test_units_draws_and_pieces_are_found_as_by_the_plain_ways():
    space = sentencepiece_sampling.SPACE
    for text in ("", "a", " a b", "a  b", " \n x\n\ny ", "\n", "x\0y z", f"{space}q", "a b\n c d\n", "é 日本 "):
        marked = (" " + text).replace(" ", space)
        assert sentencepiece_sampling.units_of(marked) == sentencepiece_sampling.UNITS.findall(marked)
    keys = np.array([0, 1, 2**63 + 5, 2**64 - 1], np.uint64)
    for step in (0, 1 << 39, (1 << 41) + 77):
        assert [sentencepiece_sampling.uniform_of(k, step) for k in keys] == sentencepiece_sampling.uniform(keys, step).tolist()
    pieces = sentencepiece_sampling.Sampler().pieces
    for hashes, begins, shift, most, found, _ in pieces.tables:
        own = hashes[: len(found)]
        # hashes as they are before the table spreads them
        back = own * np.uint64(pow(int(sentencepiece_sampling._GOLDEN), -1, 1 << 64))
        asked = np.concatenate([back, back + np.uint64(1)])
        at, k = pieces.lookup(asked, hashes, begins, shift, most)
        place = {h: n for n, h in enumerate(back.tolist())}
        assert dict(zip(at.tolist(), k.tolist(), strict=True)) == {n: place[h] for n, h in enumerate(asked.tolist()) if h in place}


# ---- language model


def test_lm_scores(spark, docs, none):
    got = {r.doc_id: r for r in lm_scoring.lm_score(docs, hot_share=0.01).collect()}
    words = {k: [*low(t).split(), b""] for k, t in enumerate(texts())}
    train = [k for k in words if zlib.crc32(str(k).encode()) % 5 != 1]
    c = Counter(w for k in train for w in words[k])
    n, v = sum(c.values()), len(c)
    for k, w in words.items():
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, k not in train)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert got[0].score == got[1].score and abs(got[7].score - got[10].score) < 1e-6
    assert lm_scoring.lm_score(none).count() == 0


def plain_log10(model, inputs, targets):
    """One window by loops and double precision: the log10 probability of its targets."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    total = 0.0
    for i, goal in enumerate(targets):
        if goal < 0:
            continue
        here = lm_scoring.CONTEXT + i
        x = {j: w["E"][model.row_of[inputs[j]]] + w["P"][j] for j in range(here + 1) if inputs[j] >= 0}
        s = {j: math.exp(x[here] @ w["Q"] @ (x[j] @ w["K"]) / lm_scoring.DIM**0.5) for j in x}
        h = x[here] + sum(s[j] * (x[j] @ w["V"]) for j in x) / sum(s.values())
        logits = np.maximum(h @ w["W1"] + w["b1"], 0) @ w["W2"] + w["b2"]
        total += (logits[model.class_of[goal]] - math.log(np.exp(logits).sum())) / math.log(10) + model.within[goal]
    return total


def plain_windows(ids):
    ids, out = list(ids), []
    for a in range(0, len(ids), lm_scoring.SCORED):
        before = [lm_scoring.END, *ids[:-1]]
        take = lambda x, k: x[k] if 0 <= k < len(x) else -1
        out.append(([take(before, a + j) for j in range(-lm_scoring.CONTEXT, lm_scoring.SCORED)], [take(ids, a + j) for j in range(lm_scoring.SCORED)]))
    return out


def chain_docs(spark, n, seed):
    """Texts in which each word says much about the next one."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        at, words = rng.randrange(40), []
        for _ in range(rng.randrange(20, 120)):
            words.append(f"{WORDS[at % 12]}{at}")
            at = (at * 3 + rng.randrange(2)) % 40
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_fitted_model_is_a_plain_forward_pass_and_beats_counts_on_unseen_rows(spark):
    docs = chain_docs(spark, 1200, 3)
    held = F.col("doc_id") % 5 == 1
    binary = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counts = lm_scoring.subword_counts(lm_scoring.word_counts(binary.filter(~held)), lm_scoring.VOCABULARY)
    windows = lm_scoring.training_windows(binary.filter(~held), lm_scoring.VOCABULARY, 16).cache()
    assert windows.count() >= 2000  # every row gives one at least
    model = lm_scoring.fit(counts, windows, shard=700)
    again = lm_scoring.fit(counts, windows.repartition(5), shard=700)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    encoding = lm_scoring.encoder(lm_scoring.VOCABULARY)
    texts = [np.array([i for w in [*r.text.encode().split(), b""] for i in lm_scoring.word_ids(encoding, w)]) for r in docs.filter(held).collect()]
    ends = np.cumsum([len(t) for t in texts])
    scores = lm_scoring.Scorer(model).score(np.concatenate(texts), ends, chunk=7)
    for ids, score in list(zip(texts, scores, strict=True))[:12]:
        assert abs(score - sum(plain_log10(model, a, b) for a, b in plain_windows(ids))) < 1e-3 * len(ids)
    by_counts = sum(np.log10((counts[ids] + 0.5) / (counts.sum() + 0.5 * lm_scoring.IDS)).sum() for ids in texts)
    assert scores.sum() / ends[-1] > by_counts / ends[-1] + 0.3
    # a later id changes no earlier window's score, and all ids of a class share its mass
    share = np.bincount(model.class_of, weights=10**model.within, minlength=lm_scoring.CLASSES)
    assert np.allclose(share[np.bincount(model.class_of, minlength=lm_scoring.CLASSES) > 0], 1)


def test_every_id_of_every_training_text_is_fitted_on_once(spark):
    rng = random.Random(7)
    said = {k: " ".join(rng.choice(WORDS) for _ in range(n)) for k, n in enumerate([0, 1, 30, 700, 2600])}
    train = spark.createDataFrame([(k, t.encode()) for k, t in said.items()], "doc_id long, text binary")
    encoding = lm_scoring.encoder(lm_scoring.VOCABULARY)
    ids = {k: [i for w in [*t.encode().split(), b""] for i in lm_scoring.word_ids(encoding, w)] for k, t in said.items()}
    for stretch in (lm_scoring.STRETCH, 50):
        rows = lm_scoring.training_windows(train, lm_scoring.VOCABULARY, stretch).collect()
        inputs, targets = lm_scoring.windows_of(np.array([r.lead for r in rows]), [r.ids for r in rows])
        pairs = Counter(zip(inputs[:, lm_scoring.CONTEXT :][targets >= 0].tolist(), targets[targets >= 0].tolist(), strict=True))
        assert pairs == Counter((a, b) for x in ids.values() for a, b in zip([lm_scoring.END, *x[:-1]], x, strict=True))
        # each window stands as it is in its text, with its context
        laid = {tuple(a) + tuple(b) for a, b in zip(inputs.tolist(), targets.tolist(), strict=True)}
        whole = {tuple(a) + tuple(b) for a, b in plain_windows(ids[3])}
        assert stretch == 50 or whole <= laid


def test_lm_scores_without_training_rows(spark):
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows = lm_scoring.lm_score(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(True, 3, 0, 0)} and all(r.score < 0 for r in rows)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, lm_scoring.IDS)
    model = lm_scoring.begun(counts, lm_scoring.classes_of(counts, None))
    ids = rng.integers(0, 300, 60)
    inputs, targets = (np.array(x) for x in zip(*plain_windows(ids), strict=True))
    goal = np.where(targets >= 0, model.class_of[targets], -1)
    g = lm_scoring.gradients(model.weights, model.row_of[inputs], inputs < 0, goal)
    # by within's leave: the loss is the mean over targets in nats
    loss = lambda: -sum(plain_log10(model, a, b) for a, b in zip(inputs, targets, strict=True)) * math.log(10) / len(ids)
    for name, at in (("Q", (3, 5)), ("K", (1, 2)), ("V", (0, 7)), ("W1", (2, 4)), ("W2", (5, 60)), ("P", (9, 3)), ("E", (model.row_of[ids[4]], 6))):
        base, step = model.weights[name].astype(float), 1e-3
        moved = []
        for sign in (1, -1):
            changed = base.copy()
            changed[at] += sign * step
            model.weights[name] = changed
            moved.append(loss())
        model.weights[name] = base.astype(np.float32)
        assert abs((moved[0] - moved[1]) / (2 * step) - g[name][at]) < 2e-3, name


def test_words_keep_their_ids_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(lm_scoring, "REMEMBERED", 3)
    words = lm_scoring.Words(lm_scoring.VOCABULARY, [b"the", b""], np.array([5, 2]))
    encoding = lm_scoring.encoder(lm_scoring.VOCABULARY)
    for said in ([b"the", b"a\xc2\xa0b", b"", b"zzz", b"the"], [b"q", b"w", b"e", b""], ["日本".encode(), b"the"]):
        ids, ends = words.ids_of(words.numbers(said))
        expected = [lm_scoring.word_ids(encoding, w) for w in said]
        assert ids.tolist() == [k for x in expected for k in x] and ends.tolist() == np.cumsum([len(x) for x in expected]).tolist()


def test_tokens_are_the_words_and_the_end():
    rng = random.Random(4)
    pieces = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\0", "A", "b", "É", "İ", "日", "Z"]
    said = [b"", b" ", b"\n\n", *("".join(rng.choice(pieces) for _ in range(rng.randrange(14))).encode() for _ in range(5000))]
    expected = [[*t.translate(LOWER_AZ).split(), b""] for t in said]
    got = lm_scoring.tokens_of(pa.array(said, pa.binary()))
    assert [[w.encode() for w in x] for x in got.to_pylist()] == expected
    # a slice has its own words alone, as a list of bytes has, and both get the same numbers
    some = lm_scoring.tokens_of(pa.array(said, pa.binary()).slice(90, 40)).flatten()
    flat = [w for x in expected[90:130] for w in x]
    words = lm_scoring.Words(lm_scoring.VOCABULARY, [b""], np.array([3]))
    assert [words.names[k] for k in words.numbers(some)] == flat and words.numbers(flat).tolist() == words.numbers(some).tolist()


def test_neighbours_are_those_of_every_target(spark):
    said = {k: " ".join(WORDS[(k * 7 + i * i) % len(WORDS)] for i in range(n)) for k, n in enumerate([0, 1, 30, 900])}
    windows = lm_scoring.training_windows(spark.createDataFrame([(k, t.encode()) for k, t in said.items()], "doc_id long, text binary"), lm_scoring.VOCABULARY, 50)
    encoding = lm_scoring.encoder(lm_scoring.VOCABULARY)
    ids = [[lm_scoring.END, *(i for w in [*t.encode().split(), b""] for i in lm_scoring.word_ids(encoding, w))] for t in said.values()]
    counts = np.bincount([k for x in ids for k in x[1:]], minlength=lm_scoring.IDS)
    rank = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")
    expected = np.zeros((lm_scoring.OWN, 12))
    for x in ids:
        for a, b in zip(rank[x[:-1]], rank[x[1:]], strict=True):
            if a < lm_scoring.OWN:
                expected[a, min(b, 5)] += 1
            if b < lm_scoring.OWN:
                expected[b, 6 + min(a, 5)] += 1
    assert np.array_equal(lm_scoring.neighbours(windows, counts, kinds=6), expected)


def test_a_descent_is_that_of_plain_steps():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, lm_scoring.IDS)
    model = lm_scoring.begun(counts, lm_scoring.classes_of(counts, None))
    inputs, targets = (np.array(x) for x in zip(*plain_windows(rng.integers(0, 300, 2400)), strict=True))
    got = lm_scoring.descend(model, inputs, targets, 0.02, seed=9, batch=40)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step, part in enumerate(np.array_split(np.random.default_rng(9).permutation(len(inputs)), 3), 1):
        goal = np.where(targets[part] >= 0, model.class_of[targets[part]], -1)
        g = lm_scoring.gradients({k: v.astype(np.float32) for k, v in w.items()}, model.row_of[inputs[part]], inputs[part] < 0, goal)
        for k in w:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k].astype(float) ** 2
            w[k] = w[k] - 0.02 * step / 20 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    assert all(np.abs(got[k] - w[k]).max() < 2e-4 for k in w) and np.abs(got["W2"] - model.weights["W2"]).max() > 1e-3


# ---- mixing


def test_mixing(spark, none):
    rng = random.Random(8)
    vocab = {"x": ["xa", "xb", "xc"], "y": ["ya", "yb", "yc"], "z": ["za", "zb"]}
    rows = [(k, " ".join(rng.choice(vocab[d]) for _ in range(rng.randrange(1, 50))), d) for k, d in enumerate(rng.choices("xyz", [6, 3, 1], k=400))] + [(400, None, "x"), (401, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    docs, labels = df.withColumn("rate", F.lit(9)), df.select("doc_id", "domain")
    weights = {"x": 0.2, "y": 0.5, "z": 0.3}
    got = mixing.soft_mix(docs, labels, weights).collect()
    assert len(got) == 402 and all(r.rate >= 0 and abs(sum(r.p.values()) - 1) < 1e-9 for r in got)
    mass = {d: sum(r.rate * r.n_tokens * r.p[d] for r in got) for d in weights}
    total = sum(r.n_tokens for r in got)
    assert all(abs(mass[d] / total - w) < 1e-3 for d, w in weights.items())
    right = sum(r.domain == rows[r.doc_id][2] for r in got if r.n_tokens)
    assert right / 400 > 0.95
    cover = mixing.soft_mix(docs, labels, weights, total="cover")
    assert cover.agg(F.min("rate")).first()[0] > 0.99
    copies = mixing.resampled(docs.drop("rate"), cover)
    assert copies.columns == ["doc_id", "text", "domain"] and copies.select("doc_id").distinct().count() >= 395
    assert mixing.soft_mix(none, labels, weights).count() == 0
    assert [r.domain for r in mixing.soft_mix(docs, labels.limit(0), weights).limit(3).collect()] == ["all"] * 3


def test_posteriors_and_rates_follow_their_definition(spark):
    rng = random.Random(12)
    vocab = {"x": ["xa", "xb", "both"], "y": ["ya", "yb", "both"]}
    rows = [(k, " ".join(rng.choice(vocab[d]) for _ in range(rng.randrange(0, 30))), d) for k, d in enumerate(rng.choices("xy", [3, 1], k=120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    bucket = lambda w: signed(xxhash.xxh64_intdigest(w, 42)) % mixing.BUCKETS
    fitted = [r for r in rows if spark.range(1).select(F.pmod(F.xxhash64(F.lit(r[0]).cast("long"), F.lit(1)), F.lit(5))).first()[0] != 0]
    counts = {d: Counter(bucket(w) for _, t, e in fitted if e == d for w in t.split()) for d in "xy"}
    prior = {d: math.log(sum(e == d for *_, e in fitted) / len(fitted)) for d in "xy"}
    weight = {}
    for b in {b for c in counts.values() for b in c}:
        logs = {d: math.log((counts[d][b] + 0.5) / (sum(counts[d].values()) + 0.5 * mixing.BUCKETS)) for d in "xy"}
        weight[b] = {d: logs[d] - sum(logs.values()) / 2 for d in "xy"}
    p, n = [], []
    for _, t, _ in rows:
        words = t.split()
        logs = [prior[d] + min(1, 4 / max(1, len(words))) * sum(weight.get(bucket(w), {d: 0})[d] for w in words) for d in "xy"]
        e = np.exp(np.array(logs) - max(logs))
        p.append(e / e.sum())
        n.append(len(words))
    got = {r.doc_id: r for r in mixing.posteriors(df, df, evidence=4)[0].collect()}
    assert all(np.allclose(got[k].p, p[k]) and got[k].n_tokens == n[k] for k in got)
    p, n = np.array(p), np.array(n)
    target, now = np.array([0.4, 0.6]) * n.sum(), n @ p
    unit = np.sqrt(now)
    m = (p * n[:, None]).T @ p / unit[:, None] / unit
    bound, rate = np.abs(m).sum(1).max(), np.ones(len(p))
    for _ in range(mixing.STEPS):
        miss = ((rate * n) @ p - target) / unit
        if (np.abs(miss * unit) / target).max() <= mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - p @ (miss / unit / bound))
    mixed = {r.doc_id: r for r in mixing.soft_mix(df, df, {"x": 0.4, "y": 0.6}, evidence=4).collect()}
    assert all(abs(mixed[k].rate - rate[k]) < 1e-6 for k in mixed)
    # the evidence is the one with the least loss on rows kept out of the fit
    assert mixing.posteriors(df, df)[1] == ["x", "y"]
    assert 0 <= mixed[0].miss <= mixing.TOLERANCE
    with pytest.warns(UserWarning, match="more steps"):
        assert mixing.soft_mix(df, df, {"x": 0.4, "y": 0.6}, steps=1, evidence=4).first().miss > mixing.TOLERANCE


# ---- pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        was = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was
        if name == "simhash":
            rows = before.select("doc_id", "text").collect()
            sets = {r.doc_id: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in rows for w in [low(r.text).split()]}
            assert ids == {k for k, v in reachable(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])).items() if k == v}
        if name in ("line_dedup", "mixing"):
            assert ids == was
        before = after
    last = corpus_pipeline.segment(spark, before, sf_dir)
    assert last.filter("NOT round_trip").isEmpty() and last.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
