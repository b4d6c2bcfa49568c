"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import whole_text

#: Bytes of a window; windows among which the rarest is chosen; how often a window must be chosen.
WINDOW, NEIGHBOURS, POPULAR = 64, 64, 16
#: Classes of entropy; bits of a filter; bits set by a feature; features of a filter.
CLASSES, FILTER_BITS, HASHES, FEATURES = 256, 2048, 5, 128
#: Bytes of the texts of one range of consecutive documents, about, and ranges at most; bytes that one numpy pass, and one step through a range, takes, about.
RANGE_BYTES, RANGES, PASS_BYTES, STEP_BYTES = 4 << 20, 100_000, 1 << 18, 1 << 20

_N = np.arange(WINDOW + 1)
_F = np.round(np.where(_N > 0, _N * np.log2(np.maximum(_N, 1)), 0) * 1024).astype(np.int64)
#: Change of the sum of n log2 n when a count rises from n - 1 to n.
_GAIN = np.diff(_F, prepend=0)
_rng = np.random.default_rng(20240101)
_MULTIPLIERS = _rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class of the entropy of each window of WINDOW bytes, in exact integer arithmetic."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    # occurrences of each byte value in order; how many of them the window from, and up to, each one holds
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + 2 * WINDOW) + order
    rank = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW) - rank
    behind[order] = rank - np.searchsorted(key, key - WINDOW, side="right") + 1
    first = int(_F[np.bincount(data[:WINDOW], minlength=256)].sum())
    # the window moves by one: the byte that enters raises its count, the one that leaves lowers its own
    left, entered = data[: n - WINDOW], data[WINDOW:]
    same = left == entered
    change = np.where(same, 0, _GAIN[np.minimum(behind[WINDOW:], WINDOW)] - _GAIN[ahead[: n - WINDOW]])
    total = np.concatenate([[first], first + np.cumsum(change)])
    # n log2 n sums to WINDOW * 6 for one repeated byte, 0 for all different
    return np.clip(((_F[WINDOW] - total) * CLASSES) // (_F[WINDOW] + 1), 0, CLASSES - 1)


def class_counts(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(CLASSES, np.int64)
    for data, _, ends in _passes(texts):
        classes = entropy_classes(data)
        inside = _whole(len(classes), ends)
        counts += np.bincount(classes[inside], minlength=CLASSES)
    return counts


def _passes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Texts joined in stretches of about PASS_BYTES: the bytes, the first text's place, the ends of the texts."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= PASS_BYTES):
            size += len(texts[to])
            to += 1
        yield np.frombuffer(b"".join(texts[at:to]), np.uint8), at, np.cumsum([len(t) for t in texts[at:to]])
        at = to


def _whole(n: int, ends: np.ndarray) -> np.ndarray:
    """Which windows lie in one text: those that don't start in the last WINDOW - 1 bytes before an end."""
    edge = np.zeros(n + WINDOW + 1, np.int32)
    np.add.at(edge, np.maximum(ends - WINDOW + 1, 0)[ends <= n + WINDOW], 1)
    np.add.at(edge, ends[ends <= n + WINDOW], -1)
    return np.cumsum(edge)[:n] <= 0 if n else np.zeros(0, bool)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy class, 0 for the rarest over the whole corpus; windows of almost one byte come last, they say little."""
    order = np.lexsort((-np.arange(CLASSES), counts))
    dull = order < CLASSES // 8
    order = np.concatenate([order[~dull], order[dull]])
    rank = np.empty(CLASSES, np.int64)
    rank[order] = np.arange(CLASSES)
    return rank


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        h += (data[at + k].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _standing_out(score: np.ndarray) -> np.ndarray:
    """The places in one text of the windows that are chosen often enough when rows of NEIGHBOURS cut off by its ends count too."""
    edge = np.full(NEIGHBOURS - 1, np.iinfo(np.int64).max)
    padded = np.concatenate([edge, score, edge])
    best = np.lib.stride_tricks.sliding_window_view(padded, NEIGHBOURS).argmin(1) + np.arange(len(score) + NEIGHBOURS - 1) - len(edge)
    return np.flatnonzero(np.bincount(best, minlength=len(score)) >= POPULAR)


def _wins(score: np.ndarray, inside: np.ndarray, among: int) -> np.ndarray:
    """How often each window is the leftmost rarest of `among` windows in a row, all in one text."""
    low, span = score, 1
    while span < among and len(low) > span:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < among:
        return np.zeros(len(score), np.int64)
    outside = np.cumsum(np.concatenate([[0], ~inside]))
    return np.bincount(low[outside[among:] == outside[:-among]] & 0xFFFFFFFF, minlength=len(score))


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's selected windows, in order. A text shorter than a window is one feature; an empty one has none.

    Where no window stands out among whole neighbourhoods, those that the text's ends cut off count too. They can but add
    windows, so a short text shares the features of a slightly longer one, and the rule is the same at every size.
    """
    out: list[np.ndarray] = []
    for data, first, ends in _passes(texts):
        starts = np.concatenate([[0], ends[:-1]])
        chosen = np.zeros(0, np.int64)
        classes = entropy_classes(data)
        if len(classes):
            n = len(classes)
            inside = _whole(n, ends)
            score = np.where(inside, rank[classes], CLASSES).astype(np.int64) << 32 | np.arange(n)
            chosen = np.flatnonzero(_wins(score, inside, NEIGHBOURS) >= POPULAR)
            none = (np.searchsorted(chosen, starts) == np.searchsorted(chosen, ends)) & (ends - starts >= WINDOW)
            more = [a + _standing_out(score[a : b - WINDOW + 1]) for a, b in zip(starts[none], ends[none], strict=True)]
            chosen = np.sort(np.concatenate([chosen, *more]))
        hashes = _hashes(data, chosen)
        lo, hi = np.searchsorted(chosen, starts), np.searchsorted(chosen, ends)
        for k, (a, b) in enumerate(zip(lo, hi, strict=True)):
            if a < b:
                out.append(hashes[a:b])
            elif starts[k] < ends[k]:  # not even one window: the whole text is the feature
                out.append(np.array([int.from_bytes(hashlib.blake2b(texts[first + k], digest_size=8).digest(), "little")], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> np.ndarray:
    """Chained filters, (n, FILTER_BITS / 64) words: FEATURES distinct features fill one, the next ones go to the next."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    n = len(hashes)
    filters = np.zeros((math.ceil(n / FEATURES), FILTER_BITS // 64), np.uint64)
    which = np.arange(n) // FEATURES
    for k in range(HASHES):
        bit = (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)
        np.bitwise_or.at(filters, (which, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return filters


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: of the digest with fewer filters, each filter's best overlap with one of the other, less what chance gives, weighed by its bits."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    ones_a, ones_b = np.bitwise_count(a).sum(1).astype(np.int64), np.bitwise_count(b).sum(1).astype(np.int64)
    best = np.empty(len(a))
    for k in range(len(a)):
        both = np.bitwise_count(a[k] & b).sum(1).astype(np.int64)
        chance = ones_a[k] * ones_b / FILTER_BITS
        most = np.minimum(ones_a[k], ones_b)
        best[k] = np.max(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), 0))
    # a digest with many more filters than the other can't be the same text
    return float(np.clip((best * ones_a).sum() / ones_a.sum(), 0, 1) * min(1.0, ones_a.sum() / ones_b.sum() * 1.5))


def text_of(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(filters.astype("<u8").tobytes()).decode()


def corpus_rarity(docs: DataFrame) -> np.ndarray:
    """Ranks by the counts of entropy classes over all windows of all texts: CLASSES numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for batch in batches:
            counts += class_counts([t.as_py() for t in batch.column(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(counts)], ["class", "n"])

    found = docs.select(whole_text().cast("binary").alias("text")).mapInArrow(run, "class long, n long")
    counts = np.zeros(CLASSES, np.int64)
    for c, n in found.groupBy("class").agg(F.sum("n")).collect():
        counts[c] = n
    return rarity(counts)


def edited(text: str, following: str) -> str:
    """The last third of the text, rounded down, replaced by as much of the beginning of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def ranges_of(rows: DataFrame, range_bytes: int) -> np.ndarray:
    """Cuts between ranges of doc_id with about `range_bytes` of text each, RANGES at most, by approximate quantiles of the ids alone."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, min(RANGES, size // range_bytes))
    if parts == 1:
        return np.zeros(0, np.int64)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], min(1_000_000, 10 * parts))).first()[0]
    return np.unique(np.array(cuts, np.int64))


def _told(ids: list[int], texts: list[str], rank: np.ndarray) -> pa.RecordBatch:
    """Of consecutive documents all but the last, which is only the next of the one before it."""
    own = len(ids) - 1
    changed = [edited(texts[k], texts[k + 1]).encode() for k in range(own)]
    whole = [digest(h) for h in features([t.encode() for t in texts], rank)]
    after_edit = [digest(h) for h in features(changed, rank)]
    columns = [
        pa.array(ids[:own], pa.int64()),
        pa.array([len(t) for t in texts[:own]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        pa.array([text_of(f) for f in whole[:own]], pa.string()),
        pa.array([text_of(f) for f in after_edit], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(whole[:own], after_edit, strict=True)], pa.float64()),
        pa.array([likeness(whole[k], whole[k + 1]) for k in range(own)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])


def fingerprint(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Windows of 64 bytes are ranked by how rare their entropy is over the whole corpus; a window that is the rarest of its
    neighbourhood often enough is a feature. The next document is that of the next smaller doc_id (after the smallest: the
    largest); rows that repeat a doc_id follow each other in the order of their texts. Documents are dealt out by ranges of doc_id, each with a
    copy of the first document of the next range, so the text crosses the shuffle once. A task steps through its sorted rows and holds about
    STEP_BYTES of them, or one text and some hundred times its bytes.

    A null text counts as empty; empty texts have a fingerprint without filters, and two of them are alike. Equal texts have equal fingerprints. A
    single row is its own next. Other columns are ignored. No rows give no rows.
    """
    rank = corpus_rarity(docs)
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    cuts = ranges_of(rows, range_bytes)

    @F.pandas_udf("long")
    def ranged(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="left"))

    tagged = rows.select(ranged("doc_id").alias("part"), "doc_id", "text", F.lit(False).alias("edge"))
    # each range needs the first document of the next lower one, the last one that of the highest: a row for each range, RANGES at most
    tops = rows.select(ranged("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top"))
    along = Window.orderBy("part")
    after = tops.select("part", F.coalesce(F.lag("top").over(along), F.max("top").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("top"))
    edges = rows.join(F.broadcast(after), F.col("doc_id") == F.col("top")).groupBy("part", "doc_id").agg(F.min("text").alias("text")).select("part", "doc_id", "text", F.lit(True).alias("edge"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, texts, held = None, [], [], 0
        for batch in batches:
            for part, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py()
                if part != here or held > STEP_BYTES:
                    if len(ids) > 1:
                        yield _told(ids, texts, rank)
                    # the last row of a step is the first of the next one; that of a range is its edge
                    ids, texts, held = (ids[-1:], texts[-1:], 0) if part == here else ([], [], 0)
                    here = part
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if len(ids) > 1:
            yield _told(ids, texts, rank)

    dealt = tagged.unionByName(edges).repartition("part").sortWithinPartitions("part", "edge", F.desc("doc_id"), "text")
    return dealt.select("part", "doc_id", "text").mapInArrow(run, OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
