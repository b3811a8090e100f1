"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def is_valid(v: Column) -> Column:
    """Not null, not empty and not all zero."""
    return v.isNotNull() & (F.size(v) > 0) & (norm(v) > 0)


def unit(v: Column) -> Column:
    """v at length one; null where v is not valid."""
    n = norm(v)
    return F.when(is_valid(v), F.transform(v, lambda x: x.cast("double") / n))


def mean_of(group: list[str], df, vector: str = "v", name: str = "v"):
    """The mean vector of each group, element by element."""
    parts = df.select(*group, F.posexplode(vector).alias("pos", "x")).groupBy(*group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias(name))
