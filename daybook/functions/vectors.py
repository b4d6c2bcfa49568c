"""Vectors as arrays: normalising, 8-bit quantising, products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once; in a lambda over elements it would be worked out for each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_normalize(v: Column) -> Column:
    """v by its length, summed in double precision; a zero vector stays."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return _let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float")))

    return _let(v, scaled)


def quantize(v: Column, single: bool = True) -> Column:
    """Scale and signed bytes. Halves round up, as floor(x + 0.5) does; the scale of a zero vector is 1.

    Quotients are floats, as the vectors are; without `single` they stay doubles, of which some fall to the other side of a half.
    """

    def packed(v: Column) -> Column:
        top = F.coalesce(F.greatest(F.array_max(v), -F.array_min(v)), F.lit(0.0))
        scale = F.when(top == 0, 1.0).otherwise(top.cast("double") / 127).cast("float")
        # Spark divides floats as doubles
        quotient = lambda x, s: (x / s).cast("float").cast("double") if single else x / s
        byte = lambda x, s: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(quotient(x, s) + 0.5))).cast("tinyint")
        return _let(scale, lambda s: F.struct(s.alias("scale"), F.transform(v, lambda x: byte(x, s)).alias("q")))

    return _let(v, packed)


def dequantize(packed: Column) -> Column:
    return F.transform(packed["q"], lambda x: (x.cast("float") * packed["scale"]).cast("float"))


def dot(v: Column, packed: Column) -> Column:
    """Product of a vector with a quantised one, in double precision."""
    return _sum(F.zip_with(v, packed["q"], lambda a, b: a.cast("double") * b.cast("double"))) * packed["scale"].cast("double")
