"""Ranked lexical search, partitioned by term: bundles of items visit the owners of their terms one after another."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import portions, written

#: Owners of terms, which a bundle visits in this order: rare terms first.
OWNERS = 4
#: A slice of documents ends at either: its postings are what an owner hands over at once.
SLICE_DOCS, SLICE_POSTINGS = 4096, 1 << 19
BUNDLE_ITEMS = 256
#: Terms of items that go to every task of the pass over the documents; items with more are searched in groups, a pass each.
VOCABULARY_BYTES = 16 << 20
#: Text is taken apart in stretches of about so many bytes.
STRETCH = 1 << 20
#: For bytes.translate: A-Z to a-z, what belongs to no term to a space.
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_SLICES = "slice long, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<int>, counts array<int>, at array<short>, tfs array<int>"
_OWNED = "slice long, terms array<int>, counts array<int>, at array<short>, gains array<long>"
_BUNDLE = "bundle int, slice long, doc_ids array<long>, items array<long>, terms array<int>, who array<int>, at array<short>, scores array<long>"


def _terms(text: bytes, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """The terms of a text in lower case, stretch by stretch; a stretch ends before a term, however long that is."""
    at = 0
    while at < len(text):
        end = at + stretch
        while end < len(text) and _SPACED[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_SPACED).split()
        at = end


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item; rows that repeat an id make one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in {t for part in _terms(text) for t in part}]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


class _Slice:
    """Documents of one task until the slice is full."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.found, self.postings, self.n_docs, self.n_terms = [], [], [], 0, 0, 0

    def add(self, doc_id: int, length: int, tfs: dict[int, int]) -> None:
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + length
        if tfs:
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.found.append(tfs)
            self.postings += len(tfs)

    def batch(self, name: int) -> pa.RecordBatch:
        """One row: documents by id, postings by term."""
        order = np.argsort(np.array(self.ids, np.int64), kind="stable")
        found = [self.found[k] for k in order]
        terms = np.fromiter((t for d in found for t in d), np.int32, self.postings)
        tfs = np.fromiter((n for d in found for n in d.values()), np.int32, self.postings)
        at = np.repeat(np.arange(len(found), dtype=np.int16), [len(d) for d in found])
        by_term = np.argsort(terms, kind="stable")
        distinct, counts = np.unique(terms, return_counts=True)
        lists = [np.array(self.ids, np.int64)[order], np.array(self.lengths, np.int64)[order], distinct, counts.astype(np.int32), at[by_term], tfs[by_term]]
        return _row([name, self.n_docs, self.n_terms], lists, _SLICES)


def _row(values: list[int], lists: list[np.ndarray], schema: str) -> pa.RecordBatch:
    """A batch of one row: whole numbers, then lists of numbers."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in schema.split(", ")]
    columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=False)]
    columns += [pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), pa.array(x)) for x in lists]
    return pa.RecordBatch.from_arrays(columns, names)


def _lists(table: pa.Table | pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [table.column(n)[row].values.to_numpy(zero_copy_only=False) for n in names]


def _sliced(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Slices of documents with the postings of the vocabulary's terms: one pass over the whole texts, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, made, here = shared.value, TaskContext.get().partitionId() << 32, 0, _Slice()
        for batch in batches:
            for part in portions(batch, 1, 8 << 20):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    length, tfs = 0, Counter()
                    for terms in _terms(text):
                        length += len(terms)
                        tfs.update(map(known.get, terms))
                    tfs.pop(None, None)
                    if length:
                        here.add(doc_id, length, tfs)
                    if len(here.ids) == SLICE_DOCS or here.postings >= SLICE_POSTINGS:
                        yield here.batch(base + made)
                        made, here = made + 1, _Slice()
        if here.n_docs:
            yield here.batch(base + made)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return written(rows.mapInArrow(run, _SLICES))


def _term_counts(slices: DataFrame) -> DataFrame:
    """Per term: its documents, its most places in one and the least length of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                terms, counts, at, tfs, lengths = _lists(batch, k, "terms", "counts", "at", "tfs", "lengths")
                if not len(terms):
                    continue
                starts = np.cumsum(counts) - counts
                columns = [terms, counts.astype(np.int64), np.maximum.reduceat(tfs, starts).astype(np.int64), np.minimum.reduceat(lengths[at], starts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "df", "tf", "length"])

    rows = slices.select("terms", "counts", "at", "tfs", "lengths").mapInArrow(run, "term int, df long, tf long, length long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("length").alias("length"))


def _gain(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, docs: int, places: int) -> np.ndarray:
    """What a term adds to the score of a document."""
    m = 100 - 50 + (50 * length * docs) // places
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def _owned(slices: DataFrame, owner: int, terms: object, docs: int, places: int) -> DataFrame:
    """Of every slice, what one owner's terms add to which document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, of, _ = terms.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts, at, tfs, lengths = _lists(batch, k, "terms", "counts", "at", "tfs", "lengths")
                mine = of[ids] == owner
                if mine.any():
                    places_of = np.repeat(mine, counts)
                    gains = _gain(np.repeat(weight[ids[mine]], counts[mine]), tfs[places_of].astype(np.int64), lengths[at[places_of]], docs, places)
                    yield _row([batch.column("slice")[k].as_py()], [ids[mine], counts[mine], at[places_of], gains], _OWNED)

    return slices.select("slice", "terms", "counts", "at", "tfs", "lengths").mapInArrow(run, _OWNED)


def _visit(bundles: DataFrame, owned: DataFrame, owner: int, terms: object, top: int) -> DataFrame:
    """The bundles after a visit to an owner; the last owner gives (item_id, doc_id, score), the best of each slice.

    A document stays in the bundle while what the later owners can add at most could still bring it to the score that `top`
    documents of the slice have already: gains are never negative, so no document of the result is lost.
    """
    last = owner == OWNERS - 1
    ints, shorts, longs = (np.zeros(0, k) for k in (np.int32, np.int16, np.int64))
    none = pa.Table.from_batches([_row([0, 0], [longs, longs, ints, ints, shorts, longs], _BUNDLE)]).slice(0, 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, of, most = terms.value
        if not left.num_rows:  # a slice for a bundle that no item fell into
            return pa.schema([(n, pa.int64()) for n in ("item_id", "doc_id", "score")]).empty_table() if last else none
        doc_ids, items, wanted, who, at, scores = _lists(left, 0, "doc_ids", "items", "terms", "who", "at", "scores")
        names, item = np.unique(items, return_inverse=True)
        sums = np.zeros((len(names), len(doc_ids)), np.int64)
        sums[who, at] = scores
        if right.num_rows:
            here, counts, places, gains = _lists(right, 0, "terms", "counts", "at", "gains")
            ends = np.cumsum(counts)
            spots = np.minimum(np.searchsorted(here, wanted), len(here) - 1)
            for i, k in zip(item[here[spots] == wanted].tolist(), spots[here[spots] == wanted].tolist(), strict=True):
                span = slice(ends[k] - counts[k], ends[k])
                sums[i, places[span]] += gains[span]
        rest = np.bincount(item, np.where(of[wanted] > owner, most[wanted], 0), len(names)).astype(np.int64)
        reached = np.partition(sums, -top, axis=1)[:, -top] if len(doc_ids) >= top else np.zeros(len(names), np.int64)
        who, at = np.nonzero((sums > 0) & (sums + rest[:, None] >= reached[:, None]))
        if not last:
            lists = [doc_ids, items, wanted, who.astype(np.int32), at.astype(np.int16), sums[who, at]]
            return pa.Table.from_batches([_row([left.column("bundle")[0].as_py(), left.column("slice")[0].as_py()], lists, _BUNDLE)])
        # documents lie by id, so a stable order by score puts the lower id first
        order = np.lexsort((at, -sums[who, at], who))
        who, at = who[order], at[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < top
        columns = [names[who[best]], doc_ids[at[best]], sums[who[best], at[best]]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return bundles.groupBy("bundle", "slice").cogroup(owned.groupBy("bundle", "slice")).applyInArrow(run, "item_id long, doc_id long, score long" if last else _BUNDLE)


def _owners(counts: DataFrame, docs: int, places: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per term: weight, owner and the most that it adds to a score. Owners have terms of falling weight and about equally many postings."""
    rows = counts.toPandas().sort_values("term")
    k, df = rows["term"].to_numpy(), rows["df"].to_numpy()
    weight, owner, most = np.zeros(size, np.int64), np.full(size, -1, np.int8), np.zeros(size, np.int64)
    weight[k] = [math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()]
    most[k] = _gain(weight[k], rows["tf"].to_numpy(), rows["length"].to_numpy(), docs, places)
    order = np.lexsort((k, -weight[k]))
    before = np.cumsum(df[order]) - df[order]
    owner[k[order]] = np.minimum(before * OWNERS // max(1, int(df.sum())), OWNERS - 1)
    return weight, owner, most


def _search(docs: DataFrame, item_terms: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(bytes(r.term) for r in item_terms.select("term").distinct().collect())
    slices = _sliced(docs, vocabulary)
    n_docs, n_places = slices.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    terms = spark.sparkContext.broadcast(_owners(_term_counts(slices), n_docs, max(1, n_places), len(vocabulary)))
    ids = spark.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ids.value[t] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["item_id", "term"])

    n_items = item_terms.select("item_id").distinct().count()
    n_bundles = max(1, -(-n_items // BUNDLE_ITEMS))
    pairs = item_terms.mapInArrow(numbered, "item_id long, term int").withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int"))
    bundles = pairs.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("item_id", "term"))).alias("pairs"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
    carried = slices.filter(F.size("terms") > 0).select("slice", "doc_ids", every).join(bundles, "bundle")
    carried = carried.select("bundle", "slice", "doc_ids", F.col("pairs.item_id").alias("items"), F.col("pairs.term").alias("terms"), empty("int").alias("who"), empty("short").alias("at"), empty("long").alias("scores"))
    for owner in range(OWNERS):
        carried = _visit(carried, _owned(slices, owner, terms, n_docs, max(1, n_places)).select("*", every), owner, terms, top)
    return carried


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item the `top` documents (doc_id, text) of the highest score above 0; equal scores by doc_id.

    A pass over the texts counts terms and packs the places of the items' terms by slices of documents. Terms belong to owners; a bundle
    of items with the sums of a slice's documents goes from owner to owner, and each adds what its terms give. Only the best of each slice
    are ranked in the end. Items whose terms together exceed `vocabulary_bytes` are searched in groups, one pass over the texts each.

    A null text has no terms; rows without doc_id or item_id take no part. Rows that repeat a doc_id are documents of their own, each with its
    rank; rows that repeat an item_id are one item with the terms of all. Texts may have any length. Other columns may have any name. Without
    documents or items there are no rows.
    """
    item_terms = written(_item_terms(items))
    size = item_terms.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).first()[0]
    groups = max(1, -(-size // vocabulary_bytes))
    found = None
    for g in range(groups):
        part = _search(docs, item_terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), top)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
