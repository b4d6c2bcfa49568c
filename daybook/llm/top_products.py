"""Exact top-k by inner product: each node holds one slice of the components of a block of vectors, and three phases settle which products are needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import written
from daybook.llm.vector_codes import whole_numbers

SCALE, TOP, SLICES = 1024, 10, 2
#: Vectors and queries in a node's block; a node multiplies so many queries at once.
BLOCK, QUERIES, STEP = 8192, 2048, 256

_NODE = ["dim", "part", "block", "asked"]


def _packed(rows: DataFrame, key: str, slices: int) -> DataFrame:
    """(dim, part, key, ids, values): a row for each slice of each block, ids ascending; a block holds about BLOCK or QUERIES vectors."""
    part = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part")
    edge = lambda p: F.floor(F.col("dim") * p / slices).cast("int")
    cut = F.slice("x", edge(F.col("part")) + 1, edge(F.col("part") + 1) - edge(F.col("part")))
    rows = rows.select("vec_id", "x", "dim", key, part).select("dim", "part", key, F.struct(F.col("vec_id").alias("id"), cut.alias("x")).alias("row"))
    lists = rows.groupBy("dim", "part", key).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return lists.select("dim", "part", key, F.col("rows.id").alias("ids"), F.flatten("rows.x").alias("values"))


class _Node:
    """One slice of a block of vectors, and the same slice of a block of queries."""

    def __init__(self, batch: pa.RecordBatch, row: int, slices: int) -> None:
        get = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
        self.dim, self.part = (batch.column(c)[row].as_py() for c in ("dim", "part"))
        width = self.dim * (self.part + 1) // slices - self.dim * self.part // slices
        self.ids, self.queries = get("ids"), get("qids")
        self.x, self.q = get("values").reshape(len(self.ids), width), get("qvalues").reshape(len(self.queries), width)
        reach = int(np.abs(self.x.astype(np.int64)).max(initial=0)) * int(np.abs(self.q.astype(np.int64)).max(initial=0)) * max(1, width)
        if reach * slices >= 1 << 63:
            raise OverflowError("an inner product doesn't fit 64 bits")
        # doubles hold these products exactly, and BLAS multiplies them
        self.kind = np.float64 if reach < 1 << 53 else np.int64

    def products(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of some queries, their products with all vectors, which of those count): a vector isn't its own candidate."""
        x = self.x.astype(self.kind).T
        for a in range(0, len(self.queries), STEP):
            k = np.arange(a, min(len(self.queries), a + STEP))
            yield k, (self.q[k].astype(self.kind) @ x).astype(np.int64), self.ids[None, :] != self.queries[k, None]

    def pairs(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.queries, queries), np.searchsorted(self.ids, ids)
        return np.concatenate([np.einsum("ij,ij->i", self.q[a[k : k + 65536]].astype(np.int64), self.x[b[k : k + 65536]].astype(np.int64)) for k in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])


def _entries(node: _Node, queries: np.ndarray, ids: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
    n = len(queries)
    columns = [pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.full(n, node.dim), pa.int32()), pa.array(np.full(n, node.part), pa.int32()), pa.array(products, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["qid", "vec_id", "dim", "part", "product"])


_ENTRIES = "qid long, vec_id long, dim int, part int, product long"


def _at_nodes(nodes: DataFrame, slices: int, ask: Callable[[_Node, pa.RecordBatch, int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """What every node answers: entries (qid, vec_id, dim, part, product)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                node = _Node(batch, row, slices)
                for found in ask(node, batch, row):
                    yield _entries(node, *found)

    return nodes.mapInArrow(run, _ENTRIES)


def _local_lists(nodes: DataFrame, slices: int, top: int) -> DataFrame:
    """Phase one: of every query the `top` highest products in each node."""

    def ask(node: _Node, batch: pa.RecordBatch, row: int) -> Iterator[tuple]:
        for k, products, counts in node.products():
            products = np.where(counts, products, -np.iinfo(np.int64).max)
            best = np.argpartition(-products, min(top, products.shape[1]) - 1, axis=1)[:, :top]
            real = np.take_along_axis(counts, best, 1)
            at = np.broadcast_to(k[:, None], best.shape)[real]
            yield node.queries[at], node.ids[best[real]], np.take_along_axis(products, best, 1)[real]

    return _at_nodes(nodes, slices, ask)


def _sufficient(nodes: DataFrame, slices: int) -> DataFrame:
    """Phase two: all products at the query's cutoff or above; without a cutoff, all."""

    def ask(node: _Node, batch: pa.RecordBatch, row: int) -> Iterator[tuple]:
        cutoff = np.full(len(node.queries), np.iinfo(np.int64).min)
        if batch.column("cut")[row].is_valid:
            known, cuts = (batch.column("cut")[row].values.field(c).to_numpy(zero_copy_only=False) for c in ("qid", "cutoff"))
            cutoff[np.searchsorted(node.queries, known)] = cuts
        for k, products, counts in node.products():
            a, b = np.nonzero(counts & (products >= cutoff[k, None]))
            yield node.queries[k[a]], node.ids[b], products[a, b]

    return _at_nodes(nodes, slices, ask)


def _missing(nodes: DataFrame, slices: int) -> DataFrame:
    """Phase three: the products that are asked for."""

    def ask(node: _Node, batch: pa.RecordBatch, row: int) -> Iterator[tuple]:
        wanted = batch.column("wanted")[row].values
        queries, ids = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("qid", "vec_id"))
        yield queries, ids, node.pairs(queries, ids)

    return _at_nodes(nodes, slices, ask)


def _place(id: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int")


class _Grid:
    """Where the blocks of vectors and queries lie, and the nodes where they meet."""

    def __init__(self, vectors: DataFrame, slices: int, block: int, queries: int) -> None:
        n, asked = vectors.agg(F.count_if("candidate"), F.count_if("query")).first()
        self.slices, self.n_blocks, self.n_asked = slices, max(1, -(-n // block)), max(1, -(-asked // queries))
        self.vectors = written(_packed(vectors.filter("candidate").withColumn("block", _place("vec_id", self.n_blocks)), "block", slices))
        self.queries = written(_packed(vectors.filter("query").withColumn("asked", _place("vec_id", self.n_asked)), "asked", slices)).withColumnsRenamed({"ids": "qids", "values": "qvalues"})

    def nodes(self) -> DataFrame:
        """Every block of queries travels to every block of vectors of its length, slice by slice."""
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        return self.vectors.withColumn("asked", every(self.n_asked)).join(self.queries.withColumn("block", every(self.n_blocks)), _NODE)

    def with_cutoffs(self, cutoffs: DataFrame) -> DataFrame:
        cuts = cutoffs.withColumn("asked", _place("qid", self.n_asked)).groupBy("dim", "asked").agg(F.collect_list(F.struct("qid", "cutoff")).alias("cut"))
        return self.nodes().join(cuts, ["dim", "asked"], "left")

    def asked_for(self, wanted: DataFrame) -> DataFrame:
        """The nodes that hold the products (qid, vec_id, dim, part), and no others."""
        at = wanted.withColumn("block", _place("vec_id", self.n_blocks)).withColumn("asked", _place("qid", self.n_asked))
        lists = at.groupBy(*_NODE).agg(F.collect_list(F.struct("qid", "vec_id")).alias("wanted"))
        return lists.join(self.vectors, ["dim", "part", "block"]).join(self.queries, ["dim", "part", "asked"])


def _sums(entries: DataFrame, slices: int) -> DataFrame:
    """(qid, vec_id, dim, seen, lack, total) per pair: the slices seen, those that lack, and the sum of what is seen."""
    pairs = entries.groupBy("qid", "vec_id", "dim").agg(F.sort_array(F.collect_set("part")).alias("seen"), F.sum("product").alias("total"))
    return pairs.withColumn("lack", F.array_except(F.sequence(F.lit(0), F.lit(slices - 1)), "seen"))


def _resolved(grid: _Grid, pairs: DataFrame) -> DataFrame:
    """(qid, vec_id, dim, total) of pairs, with the products that lack."""
    wanted = pairs.select("qid", "vec_id", "dim", F.explode("lack").alias("part"))
    found = _missing(grid.asked_for(wanted), grid.slices).select("qid", "vec_id", "dim", F.col("product").alias("total"))
    return pairs.select("qid", "vec_id", "dim", "total").unionByName(found).groupBy("qid", "vec_id", "dim").agg(F.sum("total").alias("total"))


def _kth(exact: DataFrame, top: int) -> DataFrame:
    """(qid, dim, kth): the score of rank `top`, for queries that have so many."""
    order = Window.partitionBy("qid").orderBy(F.desc("total"), "vec_id")
    return exact.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top).filter(F.col("n") == top).select("qid", "dim", F.col("total").alias("kth"))


def _numbered(vectors: DataFrame, vector: str, scale: int, every: int, top: int) -> DataFrame:
    """(vec_id, x, dim, query, candidate) of usable rows, one a vec_id. Of equal vectors the `top` + 1 of the smallest ids are candidates: all others lose every tie."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col(vector), scale).alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    single = usable.groupBy("vec_id").agg(F.min("x").alias("x"))
    # a row by row rank within equal vectors would pile a common one up in one task: each task keeps its least ids first
    ids = single.select(F.xxhash64("x").alias("h"), "x", "vec_id")
    first = ids.withColumn("n", F.row_number().over(Window.partitionBy("h", "x").orderBy("vec_id"))).filter(F.col("n") <= top + 1).select("vec_id", F.lit(True).alias("first"))
    rows = single.join(first, "vec_id", "left")
    return written(rows.select("vec_id", "x", F.size("x").alias("dim"), (F.col("vec_id") % every == 0).alias("query"), F.coalesce("first", F.lit(False)).alias("candidate")))


def top_products(vectors: DataFrame, vector: str = "embedding", every: int = 100, top: int = TOP, scale: int = SCALE, slices: int = SLICES, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id `every` divides, the `top` other rows of the highest inner product of
    floor(scale * x); ties to the smaller vec_id.

    The components are cut into `slices`; a node has one slice of a block of vectors and gets blocks of queries. Phase one gathers each node's
    highest products of every query and completes the pairs found: their score of rank `top` is a safe lower bound. Its even share per slice,
    rounded up, is the cutoff that goes to all nodes of the query: a pair that stays below it in every slice stays below the bound. Phase
    two collects all products from the cutoff on. Pairs seen in all slices are exact, and the others are kept only if what they lack could
    still bring them to the score of rank `top`; phase three asks the nodes for just those products.

    Null vectors and those with null or non-finite components take no part, nor do rows without vec_id. Rows that repeat a vec_id count once,
    with the least vector. Vectors of different length don't meet; empty ones have score 0 with each other. Components beyond 32 bits after
    scaling, and scores beyond 64, raise an error. Queries with fewer candidates get all of them. No rows give none.
    """
    rows = _numbered(vectors, vector, scale, every, top)
    grid = _Grid(rows, slices, block, queries)
    gathered = written(_resolved(grid, _sums(_local_lists(grid.nodes(), slices, top), slices)))
    # rounded up in whole numbers
    cutoffs = written(_kth(gathered, top).withColumn("cutoff", -F.expr(f"(-kth - pmod(-kth, {slices})) div {slices}")))
    pairs = written(_sums(_sufficient(grid.with_cutoffs(cutoffs.select("qid", "dim", "cutoff")), slices), slices))
    exact = pairs.filter(F.size("lack") == 0)
    bound = _kth(exact.select("qid", "vec_id", "dim", "total").unionByName(gathered).dropDuplicates(["qid", "vec_id"]), top).select("qid", F.col("kth").alias("bound"))
    # what a slice doesn't show is below the cutoff
    most = F.col("total") + F.size("lack") * (F.col("cutoff") - 1)
    open_pairs = pairs.filter(F.size("lack") > 0).join(cutoffs.select("qid", "cutoff"), "qid", "left").join(bound, "qid", "left")
    open_pairs = written(open_pairs.filter(F.coalesce(most >= F.col("bound"), F.lit(True))).select(pairs.columns))
    found = exact.select("qid", "vec_id", "dim", "total").unionByName(_resolved(grid, open_pairs))
    order = Window.partitionBy("qid").orderBy(F.desc("total"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select(F.col("qid").alias("query_id"), "rank", "vec_id", F.col("total").alias("score"))
