"""SimHash near-duplicates, found by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import LOWER_AZ, whole_text, written
from daybook.llm.graph import components

BITS, SEED = 64, 42
#: Rows of one bucket that a task compares with each other; a larger bucket is dealt out as pairs of its blocks.
BLOCK_ROWS = 1500
#: Measured relative costs of a probe row that is shuffled and sorted, and of a pair that is compared.
PROBE_COST, PAIR_COST = 1.0, 0.01


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no words: 0."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a : b - 1], SEED) for a, b in zip(starts[:n], ends[min(shingle, len(words)) - 1 :], strict=False)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _bit_statistics(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count of all fingerprints, share of ones of each bit, and the correlation of each pair: 64 x 64 sums, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            both += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS + 1)), pa.array([*both.tolist(), [n] * BITS], pa.list_(pa.int64()))], ["bit", "sums"])

    sums = points.select("fp").mapInArrow(run, "bit long, sums array<long>").select("bit", F.posexplode("sums").alias("other", "n"))
    m = np.zeros((BITS + 1, BITS))
    for bit, other, n in sums.groupBy("bit", "other").agg(F.sum("n")).collect():
        m[bit, other] = n
    n = int(m[BITS, 0])
    share = m.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    return n, share, (m[:BITS] / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; each grows by the bit that is most correlated with those it has."""
    free, groups = set(range(BITS)), []
    strength = np.abs(correlation)
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [min(free)]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _pair_estimates(n: int, same: float, share: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated pairs within 0, 1, .. bits on a group: the measured share of equal values, widened by the odds that bits differ."""
    odds = [2 * share[b] * (1 - share[b]) / max(1e-6, 1 - 2 * share[b] * (1 - share[b])) for b in group]
    near = [1.0] + [0.0] * most
    for o in odds:
        for j in range(most, 0, -1):
            near[j] += near[j - 1] * o
    return [n * n / 2 * min(1.0, same * sum(near[: j + 1])) for j in range(most + 1)]


def allocate(estimates: list[list[float]], widths: list[int], n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds t of the partitions, -1 for one that is not probed, whose sum is distance - partitions + 1, at the least estimated cost."""
    parts = len(estimates)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for pairs, width in zip(estimates, widths, strict=True):
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                ball = sum(math.comb(width, j) for j in range(t + 1))
                new = cost + (PROBE_COST * n * ball + PAIR_COST * pairs[t] if t >= 0 else 0)
                if used + t + 1 not in following or new < following[used + t + 1][0]:
                    following[used + t + 1] = (new, [*chosen, t])
        best = following
    # thresholds sum to distance - parts + 1, so t + 1 sum to distance + 1
    return best.get(distance + 1, (math.inf, [-1] * parts))


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def plan(points: DataFrame, distance: int, parts: tuple[int, ...] = (5, 4, 3, 2)) -> list[tuple[list[int], int]]:
    """The bits and the threshold of each partition that is probed, the cheapest over several counts of partitions."""
    n, share, correlation = _bit_statistics(points)
    groups = {p: group_bits(correlation, p) for p in parts}
    values = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("v")) for p in parts for k, g in enumerate(groups[p])])).alias("x")
    counts = points.select(values).groupBy("x.p", "x.k", "x.v").agg(F.count("*").alias("n"))
    same = {(r.p, r.k): r.s / max(1.0, float(n) * n) for r in counts.groupBy("p", "k").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("s")).collect()}
    best = (math.inf, [])
    for p in parts:
        estimates = [_pair_estimates(n, same.get((p, k), 0.0), share, g, distance) for k, g in enumerate(groups[p])]
        cost, thresholds = allocate(estimates, [len(g) for g in groups[p]], n, distance)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups[p], thresholds, strict=True) if t >= 0])
    return best[1]


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after a and b have been linked, pairwise: the smallest place of each component."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while not (labels == (up := labels[labels])).all():
            labels = up


def _linked(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; within a key, links between fingerprints that are near: a spanning forest, never all pairs."""
    left: tuple[np.ndarray, ...] | None = None

    def links(keys: np.ndarray, fps: np.ndarray, probes: np.ndarray) -> pa.RecordBatch:
        n = len(keys)
        last = np.searchsorted(keys, keys, side="right") - 1 if n else np.zeros(0, np.int64)
        labels, at, shift = np.arange(n), np.arange(n), 1
        found_a, found_b, waiting = [], [], 0
        while True:
            at = at[at + shift <= last[at]]
            if not len(at):
                break
            near = np.bitwise_count((fps[at] ^ fps[at + shift]).view(np.uint64)) <= distance
            # two probes of the same value prove nothing new: one of the two is in its own bucket
            near &= ~(probes[at] & probes[at + shift])
            if near.any():
                found_a.append(at[near])
                found_b.append(at[near] + shift)
                waiting += len(found_a[-1])
                if waiting > 500_000:
                    labels = _joined(labels, np.concatenate(found_a), np.concatenate(found_b))
                    found_a, found_b, waiting = [], [], 0
            shift += 1
        if found_a:
            labels = _joined(labels, np.concatenate(found_a), np.concatenate(found_b))
        out = (labels != np.arange(n)) & (fps != fps[labels])
        return pa.RecordBatch.from_arrays([pa.array(fps[out]), pa.array(fps[labels[out]])], ["a", "b"])

    for batch in batches:
        now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if left is not None:
            now = tuple(np.concatenate(x) for x in zip(left, now, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        left = tuple(x[cut:] for x in now)
        if cut:
            yield links(*(x[:cut] for x in now))
    if left is not None and len(left[0]):
        yield links(*left)


def links(points: DataFrame, distance: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints at most `distance` bits apart, enough to join all that any such link joins.

    Of every pair within the distance, some partition differs in no more bits than its threshold. There one fingerprint
    goes to the bucket of its value, the other probes all values within the threshold, and both meet. A bucket beyond
    `block_rows` is cut into blocks by a hash, and each pair of blocks becomes a bucket of its own, so no task holds a
    large bucket and every pair still meets.
    """
    probes = []
    for k, (group, threshold) in enumerate(plan(points, distance)):
        own = F.col("fp").bitwiseAND(F.lit(_mask(group)))
        flips = [_mask(c) for j in range(1, threshold + 1) for c in combinations(group, j)]
        flip = F.explode(F.array(*[F.lit(f) for f in [0, *flips]]))
        probes.append(points.select("fp", own.alias("own"), flip.alias("flip")).select("fp", F.xxhash64(F.lit(k), F.col("own").bitwiseXOR(F.col("flip"))).alias("key"), (F.col("flip") != 0).alias("probe")))
    if not probes:
        return points.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = probes[0]
    for more in probes[1:]:
        rows = rows.unionByName(more)
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("key", F.ceil(F.col("n") / block_rows).alias("blocks"))
    dealt = rows.join(large, "key", "left")
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    pair = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64(F.least(o, block), F.greatest(o, block)))))
    spread = dealt.select("fp", "probe", "key", pair.alias("pair")).select(F.xxhash64("key", "pair").alias("key"), "fp", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked(batches, distance)

    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id (the smallest doc_id that links reach, itself included).

    Equal fingerprints are one point from the start, so copies cost one row each and are never paired. A null text counts
    as empty; texts without words share fingerprint zero. A row without a doc_id is ignored. A doc_id that occurs twice gives
    two rows. Other columns are ignored. No rows give no rows.
    """
    found = written(fingerprints(docs.filter("doc_id IS NOT NULL"), shingle))
    points = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    placed = components(links(points.select("fp"), distance))
    rooted = points.join(placed.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(firsts, "root").select("fp", "component_id"))
    return found.join(named, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
