"""An exact index of quantised vectors: clusters with centre and radius, and a search that opens a cluster only while it may hold a better one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.sources.shared import cut

#: Clusters of an owner: the root of its chunks, at most so many. Rows of a block, and questions that meet it at once.
CLUSTERS, BLOCK, QUESTIONS = 1024, 4096, 1024
#: Chunks that a question's first clusters hold, in lists of the wanted length.
FIRST = 4
#: What the rounding of scores and of double sums may add to a bound.
SLACK = 2e-6

_KEY = ["owner_id", "dim"]
_ASSIGNED = "owner_id string, dim int, cluster int, chunk_id long, day string, scale float, q array<tinyint>, distance double"


def _part(id: str, n: Column, rows: int) -> Column:
    """A part of about so many rows, of n in all."""
    return F.pmod(F.xxhash64(id), F.greatest(F.lit(1), F.ceil(n / rows))).cast("int")


def _lists(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in names]


def _blocks(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows (chunk_id, day, scale, q) of equal keys in blocks of about `size`: a large group becomes many blocks."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    parts = rows.join(n, keys).withColumn("block", _part("chunk_id", F.col("n"), size))
    lists = parts.groupBy(*keys, "block").agg(F.collect_list(F.struct("chunk_id", "day", "scale", "q")).alias("rows"))
    return lists.select(*keys, "block", F.col("rows.chunk_id").alias("ids"), F.col("rows.day").alias("days"), F.col("rows.scale").alias("scales"), F.flatten("rows.q").alias("values"))


def _vectors(batch: pa.RecordBatch, row: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed bytes and scales of a block."""
    values, scales = _lists(batch, row, "values", "scales")
    return values.reshape(len(scales), dim).astype(np.float64), scales.astype(np.float64)


def _assigned(rows: DataFrame) -> DataFrame:
    """Every chunk with its nearest centre and the distance to it; centres are an owner's chunks of the least hashes."""
    n = rows.groupBy(*_KEY).agg(F.count("*").alias("n"))
    least = Window.partitionBy(*_KEY).orderBy("h", "chunk_id")
    picked = rows.withColumn("h", F.xxhash64("chunk_id")).withColumn("k", F.row_number().over(least)).filter(F.col("k") <= CLUSTERS).drop("h")
    centre = F.transform("q", lambda x: x.cast("double") * F.col("scale"))
    centres = picked.join(n, _KEY).filter(F.col("k") <= F.ceil(F.sqrt("n"))).groupBy(*_KEY).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", centre.alias("c")))), lambda r: r["c"])).alias("centres"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim = batch.column("dim")[k].as_py()
                bytes_, scales = _vectors(batch, k, dim)
                x, c = bytes_ * scales[:, None], _lists(batch, k, "centres")[0]
                c = c.reshape(-1, dim) if dim else np.zeros((1, 0))
                near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
                distance = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
                values = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dim, batch.column("values")[k].values)
                own = [pa.array([batch.column("owner_id")[k].as_py()] * len(x), pa.string()), pa.array(np.full(len(x), dim, np.int32)), pa.array(near.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own, *(batch.column(n)[k].values for n in ("ids", "days", "scales")), values, pa.array(distance)], [x.split()[0] for x in _ASSIGNED.split(", ")])

    return _blocks(rows, _KEY, BLOCK).join(centres, _KEY).mapInArrow(run, _ASSIGNED)


class VectorIndex:
    """The clusters of every owner and their blocks, of rows (owner_id, chunk_id, day, scale, q); vectors of another length are an index of their own."""

    def __init__(self, rows: DataFrame) -> None:
        rows = rows.withColumn("dim", F.size("q"))
        self.rows = cut(_assigned(rows))
        centre = F.transform("q", lambda x: x.cast("double") * F.col("scale"))
        # any member may stand for the centre, if its own distance is added to the radius; the nearest one mostly is the centre
        member = F.min_by(F.struct(centre.alias("c")), F.struct("distance", "chunk_id"))
        stats = self.rows.groupBy(*_KEY, "cluster").agg(member.alias("m"), (F.max("distance") + F.min("distance")).alias("radius"), F.count("*").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"))
        one = F.struct("cluster", F.col("m.c").alias("c"), "radius", "n", "lo", "hi")
        packed = stats.groupBy(*_KEY).agg(F.sort_array(F.collect_list(one)).alias("g"))
        self.clusters = packed.select(*_KEY, *[F.col(f"g.{x}").alias(f"c_{x}") for x in ("cluster", "radius", "n", "lo", "hi")], F.flatten("g.c").alias("c_values"))

    def blocks(self) -> DataFrame:
        return _blocks(self.rows, [*_KEY, "cluster"], BLOCK)

    def opened(self, asked: DataFrame, first: int | None) -> DataFrame:
        """(qid, owner_id, dim, cluster) to open: the likeliest clusters until they hold `first` chunks, or, without it, all that may hold a chunk of the list.

        asked has (qid, owner_id, dim, lo, hi, vec, bound): the bound is a score that the list's last chunk reaches at least, null where it isn't known.
        """
        n = asked.groupBy(*_KEY).agg(F.count("*").alias("n"))
        parts = asked.join(n, _KEY).withColumn("part", _part("qid", F.col("n"), QUESTIONS)).groupBy(*_KEY, "part").agg(F.collect_list(F.struct("qid", "lo", "hi", "vec", "bound")).alias("a"))
        packed = parts.select(*_KEY, *[F.col(f"a.{x}").alias(x) for x in ("qid", "lo", "hi", "bound")], F.flatten("a.vec").alias("vec")).join(self.clusters, _KEY)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    dim = batch.column("dim")[k].as_py()
                    qid, lo, hi, bound, vec = _lists(batch, k, "qid", "lo", "hi", "bound", "vec")
                    cluster, radius, size, c_lo, c_hi, centre = _lists(batch, k, "c_cluster", "c_radius", "c_n", "c_lo", "c_hi", "c_values")
                    q, c = vec.reshape(len(qid), dim), centre.reshape(len(cluster), dim)
                    length = np.sqrt((q**2).sum(axis=1))[:, None]
                    most = q @ c.T + length * radius * (1 + 1e-9) + SLACK
                    inside = (c_hi[None, :] >= lo[:, None]) & (c_lo[None, :] <= hi[:, None])
                    if first is None:
                        opens = most >= np.nan_to_num(bound.astype(np.float64), nan=-np.inf)[:, None]
                    else:
                        order = np.argsort(-np.where(inside, most, -np.inf), axis=1, kind="stable")
                        ordered = np.take_along_axis(np.where(inside, size, 0), order, 1)
                        opens = np.zeros(most.shape, bool)
                        np.put_along_axis(opens, order, np.cumsum(ordered, axis=1) - ordered < first, 1)
                    a, b = np.nonzero(opens & inside)
                    owner = pa.array([batch.column("owner_id")[k].as_py()] * len(a), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(qid[a], pa.int64()), owner, pa.array(np.full(len(a), dim, np.int32)), pa.array(cluster[b], pa.int32())], ["qid", "owner_id", "dim", "cluster"])

        return packed.mapInArrow(run, "qid long, owner_id string, dim int, cluster int")

    def best(self, asked: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
        """(qid, chunk_id, score) of the best `top` of every block that is opened, within the question's range."""
        keys = [*_KEY, "cluster"]
        n = pairs.groupBy(*keys).agg(F.count("*").alias("n"))
        met = pairs.join(n, keys).withColumn("part", _part("qid", F.col("n"), QUESTIONS)).join(asked.select("qid", "lo", "hi", "vec"), "qid")
        lists = met.groupBy(*keys, "part").agg(F.collect_list(F.struct("qid", "lo", "hi", "vec")).alias("a")).select(*keys, *[F.col(f"a.{x}").alias(f"a_{x}") for x in ("qid", "lo", "hi")], F.flatten("a.vec").alias("a_vec"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    dim = batch.column("dim")[k].as_py()
                    values, scales = _vectors(batch, k, dim)
                    ids, days = _lists(batch, k, "ids", "days")
                    qid, lo, hi, vec = _lists(batch, k, "a_qid", "a_lo", "a_hi", "a_vec")
                    scores = np.round(vec.reshape(len(qid), dim) @ values.T * scales, 6)
                    scores[(days[None, :] < lo[:, None]) | (days[None, :] > hi[:, None])] = -np.inf
                    if scores.shape[1] > top:
                        # everything from the last score of the list on, so that ties are all there
                        last = np.partition(scores, -top, axis=1)[:, -top]
                        a, b = np.nonzero((scores >= last[:, None]) & np.isfinite(scores))
                        order = np.lexsort((ids[b], -scores[a, b], a))
                        a, b = a[order], b[order]
                        kept = np.arange(len(a)) - np.searchsorted(a, a) < top
                        a, b = a[kept], b[kept]
                    else:
                        a, b = np.nonzero(np.isfinite(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(scores[a, b], pa.float64())], ["qid", "chunk_id", "score"])

        return self.blocks().join(lists, keys).mapInArrow(run, "qid long, chunk_id long, score double")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: VectorIndex, asked: DataFrame, top: int) -> DataFrame:
    """(qid, chunk_id, score, rank): the `top` of the highest products for every question (qid, owner_id, lo, hi, vec), ties to the lower id.

    A question first opens the clusters that promise most, until they hold FIRST * top chunks. The score of rank `top` among those is
    a bound: of the other clusters only those are opened whose centre and radius allow for it. Nothing passes through the driver. Where an
    owner or a cluster holds very many rows, they meet their counterpart in blocks, and AQE splits the joins.
    """
    asked = cut(asked.withColumn("dim", F.size("vec")).withColumn("bound", F.lit(None).cast("double")))
    opened = cut(index.opened(asked, FIRST * top))
    near = cut(index.best(asked, opened, top))
    bound = ranked(near, top).filter(F.col("rank") == top).select("qid", F.col("score").alias("bound"))
    others = index.opened(asked.drop("bound").join(bound, "qid", "left"), None).join(opened, ["qid", "owner_id", "dim", "cluster"], "left_anti")
    return ranked(near.unionByName(index.best(asked, others, top)), top)
