"""Exact nearest neighbours by cosine, gates and references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import written
from corpusloom.operators.tiles import packed, pairs, unpacked

TOP_K = 4
SIMILARITY = 0.65
#: Queries and corpus rows in a tile.
BLOCK = 1024
TILE = 16_384
#: Similarities that a task holds at a time: 4 MB, and as much again for each step of their ranking.
SLAB = 1 << 19
#: Digits of the similarity that ranks go by, so that engines agree on ties.
DIGITS = 9


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def best_places(near: np.ndarray, k: int, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best of each row, ties by the columns' keys. Only what reaches a row's k-th value is sorted."""
    shown = np.round(near, DIGITS)
    k = min(k, near.shape[1])
    least = -np.partition(-shown, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(shown >= least)
    order = np.lexsort((*(t[col] for t in reversed(ties)), -shown[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of this width and a length, their vectors)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(-1).to_numpy()
    ok = np.flatnonzero(size == width)
    flat = column.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    live = (flat * flat).sum(1) > 0
    return ok[live], flat[live]


def search(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance, similarity): each query's k nearest vectors, ties by id.

    A join of two tables in tiles: each pair of tiles is a matrix product that leaves k rows per query, and of those a task
    passes on its k best per query. Nothing but two widths comes to the driver, and both tables are scanned once. Null and zero
    vectors have no direction and no neighbours, and are nobody's; vectors of different widths raise, among the queries and
    against the corpus.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v"))
    widths = sorted(r[0] for r in asked.filter("v IS NOT NULL").select(F.size("v")).distinct().limit(3).collect())
    if len(widths) > 1:
        raise ValueError(f"the queries have vectors of different widths: {widths}")
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double, similarity double")
    blocks = written(packed(asked, BLOCK, "queries"), "queries")
    tiles = packed(corpus.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")), TILE, "corpus")
    found = pairs(blocks, tiles).mapInArrow(_products(k, widths[0]), "query_id long, vec_id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    return (
        found.withColumn("near", F.round("similarity", DIGITS)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", (1 - F.col("similarity")).alias("distance"), "similarity")
    )


def _products(k: int, width: int):
    def side(tile: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, unit vectors) of a tile's rows that have a direction."""
        batch = unpacked(tile)
        if batch.column(1).value_lengths().drop_null().unique().to_pylist() not in ([width], []):
            raise ValueError(f"the corpus has vectors of another width than {width}")
        ok, vectors = _matrix(batch.column(1), width)
        return batch.column(0).to_numpy()[ok], _unit(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for tile, asked in zip(batch.column(0), batch.column(1), strict=True):
                if (now := tile.as_py()) != last:
                    last, own = now, side(now)
                ids, units = side(asked.as_py())
                if not (len(ids) and len(own[0])):
                    continue
                step, found = max(1, SLAB // len(own[0])), []
                for at in range(0, len(ids), step):
                    near = units[at : at + step] @ own[1].T
                    row, col = best_places(near, k, own[0])
                    found.append((ids[at + row], own[0][col], near[row, col]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "similarity"])

    return run


def gate(hits: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(query_id, top, hits, passes): a query passes if its best similarity is at least the threshold."""
    return hits.groupBy("query_id").agg(F.max("similarity").alias("top"), F.count("*").alias("hits")).withColumn("passes", F.col("top") >= threshold)


def reference_counts(hits: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(query_id, refs): the number of each query's hits at or above the threshold."""
    return hits.groupBy("query_id").agg(F.count_if(F.col("similarity") >= threshold).alias("refs"))


def references(hits: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Hits at or above the threshold, numbered anew from 1 per query."""
    return hits.filter(F.col("similarity") >= threshold).withColumn("ref", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
