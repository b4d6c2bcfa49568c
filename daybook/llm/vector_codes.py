"""Product codes of vectors in whole numbers: Lloyd rounds that compare only what has moved."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A label with more than one row of so many is hot: there are fewer than that of them, so their sums are broadcast.
HOT_SHARE = 1000


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or a component isn't finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _bounds(dim: int, parts: int) -> list[int]:
    return [dim * p // parts for p in range(parts + 1)]


class Codebooks:
    """Per part the entries, and which of them the last update moved. At most PARTS * ENTRIES * the length of a part numbers."""

    def __init__(self, entries: list[np.ndarray], moved: list[np.ndarray]) -> None:
        self.entries, self.moved = entries, moved

    def updated(self, sums: list[np.ndarray], counts: list[np.ndarray]) -> Codebooks:
        """Every used entry becomes the floor of its parts' mean; unused ones stay."""
        new = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], e) for e, s, n in zip(self.entries, sums, counts, strict=True)]
        return Codebooks(new, [(a != b).any(axis=1) for a, b in zip(self.entries, new, strict=True)])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact distances (rows, entries)."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if reach * reach * max(1, x.shape[1]) >= 1 << 63:
        raise OverflowError("a squared distance doesn't fit 64 bits")
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries of the rows of x, their distances, and the number of comparisons made.

    code and distance are those of the entries before the update; code -1 stands for none. Where the assigned entry stayed, the distance
    stored is still exact and no other entry that stayed can be nearer, so only moved entries are compared; at an equal distance the lower
    index wins. All other rows rescan every entry.
    """
    code, distance = code.copy(), distance.copy()
    scan = (code < 0) | moved[code]
    if scan.any():
        d = _squared(x[scan], entries)
        code[scan] = d.argmin(axis=1)  # the first of equal ones
        distance[scan] = d.min(axis=1)
    active, stays = np.flatnonzero(moved), np.flatnonzero(~scan)
    if len(active) and len(stays):
        d = _squared(x[stays], entries[active])
        near = d.min(axis=1)
        index = active[d.argmin(axis=1)]
        better = (near < distance[stays]) | ((near == distance[stays]) & (index < code[stays]))
        code[stays[better]], distance[stays[better]] = index[better], near[better]
    return code, distance, int(scan.sum()) * len(entries) + len(stays) * len(active)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))


def _assigned(state: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    shared, cuts, parts = state.sparkSession.sparkContext.broadcast(books), _bounds(dim, len(books.entries)), len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code, distance = _matrix(batch.column("x"), dim), _matrix(batch.column("codes"), parts), _matrix(batch.column("distances"), parts)
            for p in range(parts):
                code[:, p], distance[:, p], _ = assign(x[:, cuts[p] : cuts[p + 1]], b.entries[p], b.moved[p], code[:, p], distance[:, p])
            kept = [batch.column(c) for c in ("vec_id", "label", "x")]
            yield pa.RecordBatch.from_arrays([*kept, _lists(code, pa.int8()), _lists(distance, pa.int64())], batch.schema.names)

    return state.mapInArrow(run, state.schema)


def _sums(state: DataFrame, books: Codebooks, dim: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Componentwise sums and counts of the parts of every entry: a task adds up its rows, one row an entry and place reaches the driver."""
    cuts, parts = _bounds(dim, len(books.entries)), len(books.entries)
    size = len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((size, dim), np.int64), np.zeros((size, parts), np.int64)
        for batch in batches:
            x, code = _matrix(batch.column(0), dim), _matrix(batch.column(1), parts)
            for p in range(parts):
                np.add.at(sums[:, cuts[p] : cuts[p + 1]], code[:, p], x[:, cuts[p] : cuts[p + 1]])
                counts[:, p] += np.bincount(code[:, p], minlength=size)
        both = np.concatenate([sums, counts], axis=1)
        entry, place = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place), pa.array(both[entry, place])], ["entry", "place", "n"])

    found = state.select("x", "codes").mapInArrow(run, "entry long, place long, n long").groupBy("entry", "place").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((size, dim + parts), np.int64)
    for entry, place, n in found:
        both[entry, place] = n
    return [both[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [both[:, dim + p] for p in range(parts)]


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over rows of an equal label. Sums of hot labels, fewer than HOT_SHARE, are broadcast; the others are joined by label."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    total = rows.count()
    hot = sums.filter(F.col("n") * HOT_SHARE > total).select(F.col("label").alias("hot"), "label_error", F.lit(True).alias("is_hot"))
    flagged = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left").drop("hot")
    cold = sums.filter(F.col("n") * HOT_SHARE <= total).select(F.col("label").alias("cold"), "label_error")
    rare = flagged.filter("is_hot IS NULL").drop("label_error").join(cold, F.col("label").eqNullSafe(F.col("cold"))).drop("cold")
    return flagged.filter("is_hot").drop("is_hot").unionByName(rare.drop("is_hot"))


def vector_codes(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of vectors (vec_id, label, vector).

    Components become floor(scale * x), vectors are cut into `parts` equal parts, and each part's codebook starts as that part of the rows with
    the smallest vec_ids. Rounds assign every part to the nearest entry and move the entries to the floor of their parts' mean; the
    table of a round holds each part's entry and exact distance, so the next one compares parts whose entry stayed with moved entries alone.
    Codebooks are the only thing that is broadcast, and their sums the only thing that reaches the driver: a fixed number of numbers.

    Rows whose vector is null or has null or non-finite components are dropped, as are those whose length isn't that of the kept row with the
    smallest vec_id (nulls are last, equal ids by their components). A length that `parts` doesn't divide is cut at its floors; vectors
    without components have error 0. Components beyond 32 bits after scaling, and distances beyond 64, raise an error. Rows that
    repeat a vec_id count each. A null vec_id stays null. With fewer rows than `entries` the codebooks have fewer entries. No rows give none.
    """
    columns = set(vectors.columns)
    label = F.col("label") if "label" in columns else F.lit(None).cast("int")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole_numbers(F.col(vector), scale).alias("x")).filter("x IS NOT NULL")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    dim = len(first[0].x) if first else 0
    kept = kept.filter(F.size("x") == dim)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    cuts, n = _bounds(dim, parts), max(1, len(start))
    grid = np.array([r.x for r in start], np.int64).reshape(len(start), dim) if start else np.zeros((1, dim), np.int64)
    books = Codebooks([grid[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [np.ones(n, bool)] * parts)
    state = kept.withColumn("codes", F.array_repeat(F.lit(-1).cast("byte"), parts)).withColumn("distances", F.array_repeat(F.lit(0).cast("long"), parts))
    before = None
    for _ in range(rounds):
        state = written(_assigned(state, books, dim))
        if before is not None:
            discard(before)
        before = state
        books = books.updated(*_sums(state, books, dim))
    last = written(_assigned(state, books, dim))
    if before is not None:
        discard(before)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("int")), 2, "0"))), "")
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d)
    return _with_label_errors(last.select("vec_id", "label", code.alias("code"), error.alias("error"))).withColumn("codebooks_sha256", F.lit(books.digest()))
