"""Which incoming documents need work: unchanged, duplicate, failed, fresh or modified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Known documents, or incoming ones, up to which that side of the lookup is broadcast.
BROADCAST_KNOWN = 200_000


def classify(incoming: DataFrame, known: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, content_hash, has_text) against (path, content_hash): adds known_hash, status and the columns `keep` of a known path.

    unchanged: the path has this hash. duplicate: the path is unknown and the hash is known, or an earlier path of this
    batch brings the same hash and text. failed: no text. Else modified for a known path and fresh for a new one. Both
    lookups are left joins on one key. The smaller side goes to the other where it is small enough, so a small batch shuffles
    none of the known rows; of two large sides a copied file's hot hash is split by the adaptive skew join.
    """
    few = lambda rows: rows.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN
    by_path = known.select("path", F.nullif(F.col("content_hash"), F.lit("")).alias("known_hash"), *keep)
    hashes = known.select("content_hash").filter("content_hash <> ''")
    small = few(known)
    if not small and few(incoming):
        # A small batch goes to the known rows, which stay where they are; what it meets is no larger than the batch.
        small = True
        by_path = by_path.join(F.broadcast(incoming.select("path").distinct()), "path", "left_semi")
        hashes = hashes.join(F.broadcast(incoming.select("content_hash").distinct()), "content_hash", "left_semi")
    side = F.broadcast if small else (lambda d: d)
    hashes = hashes.distinct().withColumn("hash_known", F.lit(True))
    seen = incoming.join(side(by_path), "path", "left").join(side(hashes), "content_hash", "left")
    old = F.col("known_hash").eqNullSafe(F.col("content_hash")) & F.col("known_hash").isNotNull()
    copy = F.col("known_hash").isNull() & F.coalesce(F.col("hash_known"), F.lit(False))
    first = (
        F.when(old, F.lit("unchanged")).when(copy, F.lit("duplicate")).when(~F.col("has_text"), F.lit("failed"))
        .when(F.col("known_hash").isNull(), F.lit("fresh")).otherwise(F.lit("modified"))
    )
    # The smallest new path of each hash, by partial aggregation rather than a window over a hot hash.
    seen = seen.withColumn("first", first)
    owner = seen.filter("first IN ('fresh', 'modified')").groupBy("content_hash").agg(F.min("path").alias("owner"))
    late = F.col("first").isin("fresh", "modified") & (F.col("owner") != F.col("path"))
    return (
        seen.join(owner, "content_hash", "left")
        .withColumn("status", F.when(late, F.lit("duplicate")).otherwise(F.col("first")))
        .select("path", "content_hash", "known_hash", "status", *keep)
    )


def counters(status: DataFrame) -> DataFrame:
    """One row: documents stored, skipped and failed."""
    return status.agg(
        F.count_if(F.col("status").isin("fresh", "modified")).alias("docs"),
        F.count_if(F.col("status").isin("unchanged", "duplicate")).alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def drop_repeats(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Rows whose line differs from the one before it in their key, as a history keeps them."""
    last = F.lag(line).over(Window.partitionBy(key).orderBy(order))
    return lines.withColumn("__last", last).filter(~F.col("__last").eqNullSafe(F.col(line)) | F.col("__last").isNull()).drop("__last")
