"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import partitions


#: Rows below which one range is enough, and sampled keys for each range where keys are strings.
SMALL = 10_000
SAMPLED = 40


def _cuts(df: DataFrame, key: str, ranges: int | None) -> list:
    n = ranges or partitions(df.sparkSession)
    if n < 2 or (not ranges and df.limit(SMALL).count() < SMALL):
        return []
    if dict(df.dtypes)[key] != "string":
        return sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)))
    share = min(1.0, 2.0 * SAMPLED * n / df.count())
    seen = sorted(r[0] for r in df.select(key).dropna().sample(share, 42).limit(4 * SAMPLED * n).collect())
    return sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []


def running(df: DataFrame, key: str, name: str, amount: str | None = None, ranges: int | None = None, then: str | None = None) -> DataFrame:
    """Adds the sum of the column `amount` (none: 1 a row) over all rows up to this one, by a numeric or string key, nulls first,
    and by the column `then` among equal keys.

    The key is cut into ranges at sampled quantiles. Sums run within a range; a range's offset is the sum of all before it,
    from one row per range.
    """
    kind = "string" if dict(df.dtypes)[key] == "string" else "double"
    cuts = _cuts(df, key, ranges)
    marks = F.array(*map(F.lit, cuts)).cast(f"array<{kind}>")
    part = F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.size(F.filter(marks, lambda c: c <= F.col(key).cast(kind))))
    one = F.lit(1) if amount is None else F.coalesce(F.col(amount), F.lit(0))
    placed = df.withColumn("__part", part).withColumn("__one", one.cast("long"))
    totals = placed.groupBy("__part").agg(F.sum("__one").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(F.asc_nulls_first(key), *([then] if then else [])).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("__local", F.sum("__one").over(within)).join(F.broadcast(offsets), "__part")
    return local.withColumn(name, F.col("__local") + F.col("__before")).drop("__part", "__local", "__before", "__one")


def numbered(df: DataFrame, key: str, name: str = "rn", ranges: int | None = None, then: str | None = None) -> DataFrame:
    """Adds 1-based row numbers by a key, as running() orders rows."""
    return running(df, key, name, None, ranges, then)
