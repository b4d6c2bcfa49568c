"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import written


def _followed(parents: DataFrame) -> DataFrame:
    """(node, parent) with every chain shortened to its end; a parent is always smaller than its node."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
        moved = written(parents.join(up, "parent", "left").select("node", F.coalesce("upper", "parent").alias("parent"), F.col("upper").isNotNull().alias("moved")))
        parents = moved.select("node", "parent")
        if moved.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node that can be reached.

    Each round hangs every node under its smallest neighbour, shortens the chains, and contracts the links to the ends
    found; rounds are few, since each joins whole neighbourhoods. Rows stay in tables, none on the driver. Loops and nulls
    are ignored; an empty table gives an empty one.
    """
    edges = written(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct())
    roots = None
    while not edges.isEmpty():
        parents = _followed(written(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))))
        if roots is None:
            roots = parents
        else:
            # nodes placed earlier move with their root; new ones are added
            moved = roots.join(parents.withColumnRenamed("parent", "upper"), F.expr("parent") == parents["node"], "left").select(roots["node"], F.coalesce("upper", "parent").alias("parent"))
            roots = written(moved.unionByName(parents.join(roots.select("node"), "node", "left_anti")))
        lo = parents.select(F.col("node").alias("lo"), F.col("parent").alias("lo_root"))
        hi = parents.select(F.col("node").alias("hi"), F.col("parent").alias("hi_root"))
        ends = edges.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_root", "lo").alias("a"), F.coalesce("hi_root", "hi").alias("b"))
        edges = written(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct())
    if roots is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    ends = roots.select(F.col("parent").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.select("node", F.col("parent").alias("root")).unionByName(ends)
