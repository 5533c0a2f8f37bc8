"""Vector functions over array<float> columns, as JVM expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def l2_normalize(v: Column) -> Column:
    """The vector over its length, as floats; one of length at most 1e-12 stays as it is."""
    n = norm(v)
    return F.when(n > _TINY, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null where a vector has no length."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, place, mean): the mean of each component over a key's vectors, by partial aggregation."""
    return rows.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
