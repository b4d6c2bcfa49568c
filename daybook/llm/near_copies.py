"""Near copies by the Jaccard similarity of their sets of five-word shingles: SimHash links first, then whatever else is similar enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import LOWER_AZ, discard, distinct, portions, whole_text, written
from daybook.llm.graph import components
from daybook.llm.simhash import links as simhash_links

SHINGLE, SEED, DISTANCE = 5, 42, 4
#: The least similarity of a link, as a fraction.
SIMILAR, OF = 4, 5
#: Counters of how common shingles are; bytes of texts that one numpy pass takes, about.
COUNTERS, PASS_BYTES = 1 << 16, 1 << 20
#: A token with more than one row of so many is hot.
HOT_SHARE = 1000
#: Ids that a join broadcasts at most; more are shuffled.
BROADCAST_IDS = 1_000_000


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts the sorted distinct hashes of their shingles, end to end, and where each text's end. Fewer words than a shingle has are one shingle, no words give none."""
    split = [t.translate(LOWER_AZ).split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = [w for ws in split for w in ws]
    if not words:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    firsts, codes = distinct(pa.array(words, pa.large_binary()))
    hashes = np.fromiter((xxhash.xxh64_intdigest(words[k], SEED) for k in firsts.tolist()), np.uint64, len(firsts))[codes]
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes > 0, np.maximum(1, sizes - shingle + 1), 0)
    row = np.repeat(np.arange(len(texts)), counts)
    at = starts[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    h = np.zeros(len(row), np.uint64)
    for k in range(shingle):
        inside = k < sizes[row]
        with np.errstate(over="ignore"):
            h[inside] = _mixed(h[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[inside] + k])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return h[new], np.cumsum(np.bincount(row[new], minlength=len(texts)))


def _fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is 1 if more than half of the hashes have it; 0 for an empty set."""
    sizes = np.diff(ends, prepend=0)
    ones = np.zeros((len(ends) + 1, 64), np.int64)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[some] = np.add.reduceat(bits, (ends - sizes)[some], axis=0, dtype=np.int64)
    return np.packbits(2 * ones[:-1] > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))


def _passes(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in portions(batch, column, PASS_BYTES):
            yield part, *shingle_sets(part.column(column).to_pylist())


def _commonness(docs: DataFrame) -> np.ndarray:
    """How many shingles fall to each counter: COUNTERS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for _, hashes, _ in _passes(batches, 0):
            counts += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTERS)), pa.array(counts)], ["k", "n"])

    found = np.zeros(COUNTERS, np.int64)
    for k, n in _texts(docs).select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        found[k] = n
    return found


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, fp, prefix): node is a hash of the whole set, n its size, fp its SimHash, prefix the rarest shingles, as many as one of a set that
    is similar enough must be among. Of rows with one set in a task only the first has the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(_commonness(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = shared.value
        for part, hashes, ends in _passes(batches, 1):
            sizes = np.diff(ends, prepend=0)
            row = np.repeat(np.arange(len(ends)), sizes)
            order = np.lexsort((hashes, counts[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)], row))
            place = np.arange(len(hashes)) - (ends - sizes)[row]
            most = np.where(sizes > 0, sizes - (SIMILAR * sizes + OF - 1) // OF + 1, 0)
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(hashes[e - s : e].tobytes()) for s, e in zip(sizes, ends, strict=True)), np.uint64, len(ends))
            first = np.zeros(len(ends), bool)
            for k, node in enumerate(nodes.tolist()):
                if node not in seen:
                    seen.add(node)
                    first[k] = True
            chosen = (place < most[row]) & first[row]
            offsets = np.concatenate([[0], np.cumsum(np.where(first, most, 0))])
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[order][chosen].view(np.int64)), mask=pa.array(~first))
            fps = _fingerprints(hashes, ends)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(fps.view(np.int64)), prefix], ["doc_id", "node", "n", "fp", "prefix"])

    return _texts(docs).mapInArrow(run, "doc_id long, node long, n long, fp long, prefix array<long>")


def _sets_of(docs: DataFrame, asked: DataFrame, repeats: bool) -> DataFrame:
    """(node, s): the shingles of the asked (first, node), from the text of the document `first`."""
    few = asked.count() <= BROADCAST_IDS
    sent = F.broadcast if few else lambda df: df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, ends in _passes(batches, 1):
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(hashes.view(np.int64)))
            nodes = [xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), sets], ["node", "s"])

    rows = _texts(docs).join(sent(asked.select(F.col("first").alias("doc_id")).distinct()), "doc_id", "left_semi")
    # rows may repeat a doc_id, with this text or another
    sets = rows.mapInArrow(run, "node long, s array<long>").join(sent(asked.select("node")), "node", "left_semi")
    return sets.dropDuplicates(["node"]) if repeats else sets


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = written(nodes.select("node", "first").join(ends, "node", "left_semi"))
    have = written(_sets_of(docs, asked, repeats))
    both = pairs.join(have.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(have.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    found = written(shared.filter(F.col("shared") * OF >= (F.col("total") - F.col("shared")) * SIMILAR).select("a", "b"))
    discard(pairs, asked, have)
    return found


def _enough(n: Column, place: Column, other_n: Column, other_place: Column) -> Column:
    """Whether what follows the first shared shingle of two sets can still make them similar enough; true of no pair of too different sizes."""
    return F.least(n - place, other_n - other_place) * (SIMILAR + OF) >= (n + other_n) * SIMILAR


def _simhash_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal or within `distance` bits: enough to join all that such links join."""
    stands = written(nodes.groupBy("fp").agg(F.min("node").alias("stand")))
    found = simhash_links(stands.select("fp"), distance)
    same = nodes.join(stands, "fp").select(F.col("node").alias("a"), F.col("stand").alias("b"))
    a, b = (stands.select(F.col("fp").alias(x), F.col("stand").alias(f"{x}_node")) for x in "ab")
    return same.unionByName(found.join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _placed(tokens: DataFrame, placed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """tokens with the root of each node; and of each token whose nodes have several roots (token, one, other: two of its rows)."""
    rows = tokens.withColumn("root", F.col("node")) if placed is None else tokens.join(placed, "node", "left").withColumn("root", F.coalesce("root", "node"))
    row = F.struct("node", "n", "place", "root")
    mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(row, F.xxhash64("node")).alias("one"), F.max_by(row, F.xxhash64("node")).alias("other")).filter("lo < hi")
    return rows, mixed.select("token", "one", "other")


def _met(rows: DataFrame) -> DataFrame:
    """Rows with `leader`, another row of their token, every two of a token once. A token of more than one row in HOT_SHARE is dealt out: its rows meet in
    parts, and only where the sizes of their sets may go together. There are fewer than HOT_SHARE such tokens, so those are broadcast."""
    total = rows.count()
    hot = rows.groupBy("token").agg(F.count("*").alias("many")).filter(F.col("many") * HOT_SHARE > total).select("token", F.ceil(F.col("many") * HOT_SHARE / max(1, total)).cast("int").alias("parts"))
    # sets whose sizes are within OF / SIMILAR of each other are at most one step apart
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OF / SIMILAR + 0.01))).cast("int")
    marked = rows.join(F.broadcast(hot), "token", "left").withColumn("step", F.when(F.col("parts").isNull(), 0).otherwise(step)).withColumn("parts", F.coalesce("parts", F.lit(1)))
    others = marked.select("token", "step", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.struct("node", "n", "place", "root").alias("leader"))
    steps = F.when(F.col("parts") > 1, F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).otherwise(F.array("step"))
    dealt = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("step", F.explode(steps)).drop("parts")
    return dealt.join(others, ["token", "step", "part"]).filter(F.col("node") < F.col("leader.node"))


def _near(met: DataFrame) -> DataFrame:
    """(a, b) of rows that meet another in `leader`: those of different roots whose sets can be similar enough."""
    near = met.filter(F.col("root") != F.col("leader.root")).filter(_enough(F.col("n"), F.col("place"), F.col("leader.n"), F.col("leader.place")))
    return near.select(F.col("node").alias("a"), F.col("leader.node").alias("b"))


def near_components(nodes: DataFrame, docs: DataFrame, repeats: bool, distance: int = DISTANCE) -> DataFrame:
    """(node, root) of the sets that links of enough similarity join, root the least of them. nodes: (node, first, n, fp, prefix); repeats: whether rows may repeat a doc_id.

    SimHash's links come first, and the pairs of every set with two leaders of each shingle of its prefix: verified, they join most of a
    group of near copies at a few pairs a set. Two similar sets share a shingle of their prefixes, so at last every pair that
    shares one and isn't joined yet is compared. Shingles that are common stand last in every set.
    """
    nodes = nodes.filter("n > 0")
    every = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "token"))
    shared = every.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token")
    tokens = written(every.join(shared, "token", "left_semi"))
    rows, mixed = _placed(tokens, None)
    led = rows.join(mixed.select("token", F.explode(F.array("one", "other")).alias("leader")), "token")
    links = _verified(_simhash_pairs(nodes, distance).unionByName(_near(led)), nodes, docs, repeats)
    placed = written(components(links))
    rows, mixed = _placed(tokens, placed)
    mine = written(rows.join(mixed.select("token"), "token", "left_semi"))
    more = _verified(_near(_met(mine)), nodes, docs, repeats)
    discard(tokens, mine)
    if more.isEmpty():
        return placed
    return components(placed.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the smallest doc_id that links of Jaccard similarity >= SIMILAR / OF reach, itself included).

    Words are split at white space after lower-casing A-Z. A null text counts as empty; texts without words are copies of each
    other. A row without a doc_id is ignored; rows that repeat one are rows of their own. Texts are worked on whole, some hundred bytes a word.
    Other columns are ignored. No rows give no rows.
    """
    found = written(_members(docs))
    repeats = not found.groupBy("doc_id").count().filter("count > 1").isEmpty()
    nodes = written(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix", ignorenulls=True).alias("prefix")))
    rooted = written(nodes.select("node", "first").join(near_components(nodes, docs, repeats), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.select("doc_id", "node").join(rooted.join(firsts, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
