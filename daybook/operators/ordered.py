"""What comes before a row of an owner, found hour by hour: a busy owner is spread over tasks, and only one row an hour meets in one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def _hour(at: str) -> Column:
    return F.floor(F.col(at) / HOUR_MS)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of a key in one task, for functions over partitions.

    Over a join by the same keys Spark leaves a repartition by plain columns out, as the join deals rows alike; when AQE then makes that join a
    broadcast one, it reads the shuffle beneath in parts, and a key's rows end up in several tasks. A struct of the keys is never left out.
    """
    return df.repartition(F.struct(*keys))


def with_previous(df: DataFrame, columns: list[str], order: list[str], key: str = "owner_id") -> DataFrame:
    """df with `previous`: a struct of the columns of the key's row before, in this order; null for the first. order begins with milliseconds."""
    rows = df.withColumn("_hour", _hour(order[0]))
    value = F.struct(*columns)
    w = Window.partitionBy(key, "_hour").orderBy(*order)
    last = rows.groupBy(key, "_hour").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    edges = last.withColumn("_edge", F.lag("_last").over(Window.partitionBy(key).orderBy("_hour"))).select(F.col(key).alias("_key"), F.col("_hour").alias("_at"), "_edge")
    both = rows.withColumn("_inside", F.lag(value).over(w)).join(edges, F.col(key).eqNullSafe(F.col("_key")) & F.col("_hour").eqNullSafe(F.col("_at")))
    return both.withColumn("previous", F.coalesce("_inside", "_edge")).drop("_hour", "_inside", "_key", "_at", "_edge")


def since_mark(df: DataFrame, mark: str, at: str, name: str, key: str = "owner_id") -> DataFrame:
    """df with `name`: the place (milliseconds, column `at`) of the key's latest row up to this one whose mark is true."""
    rows = df.withColumn("_hour", _hour(at))
    marked = F.when(F.col(mark), F.col(at))
    w = Window.partitionBy(key, "_hour").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.groupBy(key, "_hour").agg(F.max(marked).alias("_top"))
    before = Window.partitionBy(key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    edges = tops.select(F.col(key).alias("_key"), F.col("_hour").alias("_at"), F.max("_top").over(before).alias("_edge"))
    both = rows.withColumn("_inside", F.max(marked).over(w)).join(edges, F.col(key).eqNullSafe(F.col("_key")) & F.col("_hour").eqNullSafe(F.col("_at")))
    return both.withColumn(name, F.coalesce("_inside", "_edge")).drop("_hour", "_inside", "_key", "_at", "_edge")


def running_sums(df: DataFrame, at: str, sums: dict[str, Column], key: str = "owner_id", part_ms: int = 24 * HOUR_MS) -> DataFrame:
    """df with running sums of the key's rows by `at`: within parts of part_ms, plus what the parts before add up to."""
    rows = df.withColumn("_part", F.floor(F.col(at) / part_ms))
    w = Window.partitionBy(key, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(key, "_part").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in enumerate(sums.values())])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_edge_{k}") for k in range(len(sums))])
    both = rows.select("*", *[F.sum(c).over(w).alias(f"_inside_{k}") for k, c in enumerate(sums.values())]).join(edges, F.col(key).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_at")))
    return both.select(*df.columns, *[(F.col(f"_inside_{k}") + F.col(f"_edge_{k}")).alias(name) for k, name in enumerate(sums)])
