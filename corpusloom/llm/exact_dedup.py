"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort places equal texts next to each other, and
one pass over each sorted partition compares neighbours in full. Within a run of equal texts the sort puts the row to keep
first, so a run is settled by its first row and its length.

Splitters are sampled from a bounded key (the first bytes of the normalised text, its 64-bit hash, then the order of
preference), never from whole texts, so what the driver gathers for them does not grow with the length of texts. The key
also splits a run of copies over several partitions when the run is larger than one: runs that touch the edge of a partition
are stitched afterwards from two rows per partition, found by length and SHA-256 of the whole normalised text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, with_row_ids, without, written

#: Code points of the normalised text that splitters see.
SPLITTER_PREFIX = 48
_ROWS_PER_BATCH = 20_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space (tab to carriage return, and space); null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for mark in (" ", "\n", "\t", "\r", "\x0b", "\f"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (row, id, norm) of one partition to (row, id, keep_row, keep, size, sha, first, part, edge).

    edge: 0 inside the partition, 1 the run that opens it, 2 the run that closes it, 3 both. One text and the ids of the
    current run are in memory.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["row", "id", "keep_row", "keep", "size", "sha", "first", "part", "edge"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
    out: list[list] = [[] for _ in names]
    rows: list[int] = []
    ids: list[int | None] = []
    current: str | None = None
    runs = 0

    def close(edge: int) -> Iterator[pa.RecordBatch]:
        sha, size = hashlib.sha256(current.encode()).hexdigest(), len(rows)
        at = 0
        while at < size:
            n = min(size - at, _ROWS_PER_BATCH)
            out[0] += rows[at : at + n]
            out[1] += ids[at : at + n]
            for k, v in ((2, rows[0]), (3, ids[0]), (4, size), (5, sha), (7, part), (8, edge)):
                out[k] += [v] * n
            out[6] += [at == 0] + [False] * (n - 1)
            at += n
            if len(out[0]) >= _ROWS_PER_BATCH:
                yield flush()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        for row, one, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if text != current:
                if current is not None:
                    yield from close(1 if runs == 0 else 0)
                    runs += 1
                rows.clear()
                ids.clear()
                current = text
            rows.append(row)
            ids.append(one)
    if current is not None:
        yield from close(3 if runs == 0 else 2)
    if out[0]:
        yield flush()


def content_sort(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str = f"{OWN}row") -> DataFrame:
    """Groups rows of equal normalised text.

    `rows` needs a unique `row` column. Returns (row, doc_id, keep_row, keep_id, group_size, kept, text_sha256): of each
    group the row with the most code points in the original text, then the smallest id (nulls last), then the smallest
    row number is kept. Null texts count as empty, and empty texts are one group. An empty table gives an empty table.
    Repeated rows are rows of their own, so exactly one row of each group is kept.
    """
    keyed = rows.select(
        F.col(row).alias("row"),
        F.col(doc_id).cast("long").alias("id"),
        normalised(F.col(text)).alias("norm"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
    ).select("*", F.substring("norm", 1, SPLITTER_PREFIX).alias("head"), F.xxhash64("norm").alias("hash"))
    best = [F.desc("n"), F.asc_nulls_last("id"), F.asc("row")]
    settled = written(
        keyed.repartitionByRange("head", "hash", *best)
        .sortWithinPartitions("head", "hash", "norm", *best)
        .select("row", "id", "norm")
        .mapInArrow(_settle_runs, "row long, id long, keep_row long, keep long, size long, sha string, first boolean, part int, edge int"),
        "content-sort",
    )
    # Two rows a partition at most: the first row of the run that opens it and of the run that closes it.
    edges = settled.filter("first and edge > 0").groupBy("sha").agg(
        F.min(F.struct("part", "keep_row", "keep")).alias("head"), F.sum("size").alias("total")
    ).select("sha", F.col("head.keep_row").alias("edge_row"), F.col("head.keep").alias("edge_keep"), "total")
    stitched = settled.join(F.broadcast(edges), "sha", "left")
    at_edge = (F.col("edge") > 0) & F.col("total").isNotNull()
    keep_row = F.when(at_edge, F.col("edge_row")).otherwise(F.col("keep_row"))
    return stitched.select(
        F.col("row").alias(row),
        F.col("id").alias("doc_id"),
        keep_row.alias("keep_row"),
        F.when(at_edge, F.col("edge_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(at_edge, F.col("total")).otherwise(F.col("size")).alias("group_size"),
        (F.col("row") == keep_row).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`, see content_sort(): (doc_id, keep_id, group_size, kept, text_sha256)."""
    return content_sort(with_row_ids(docs.select(doc_id, text)), text, doc_id).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that exact_dedup() keeps, with all their columns; an empty table gives an empty one."""
    rows = with_row_ids(docs)
    dropped = written(content_sort(rows, text, doc_id).filter("not kept").select(f"{OWN}row"), "copies")
    return without(rows, dropped).drop(f"{OWN}row")
