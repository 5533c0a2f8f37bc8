"""Retrieval over chunked documents with hashed words, as a join of two tables in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.embed import DIMENSION, HashedWords
from corpusloom.operators.chunking import chunk
from corpusloom.operators.knn import DIGITS, SIMILARITY, TOP_K, best_places
from corpusloom.operators.tables import spread, written
from corpusloom.operators.tiles import packed, pairs, unpacked

#: Questions and chunks in a tile; a chunk's vector has 8 KB.
BLOCK = 1024
TILE = 2048


def retrieve(docs: DataFrame, questions: DataFrame, k: int = TOP_K, threshold: float = SIMILARITY, question_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, chunk_idx, similarity, passes): the k nearest chunks of each question, ties by ids.

    passes: whether the question's best chunk reaches the threshold. A join of two tables in tiles, as in knn.search(): tiles
    hold texts, which a task embeds once for all questions that a tile meets; no question comes to the driver and documents are
    chunked once. Blank questions and chunks match nothing.
    """
    asked = questions.select(F.col(question_id).cast("long").alias("q"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    blocks = written(packed(asked, BLOCK, "queries"), "questions")
    tiles = packed(chunk(spread(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_idx", "content"), TILE, "corpus")
    found = pairs(blocks, tiles).mapInArrow(_products(k), "item_id long, doc_id long, chunk_idx int, similarity double")
    by = Window.partitionBy("item_id")
    ranked = found.withColumn("near", F.round("similarity", DIGITS)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("near"), "doc_id", "chunk_idx")))
    return ranked.filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "chunk_idx", "similarity", (F.max("near").over(by) >= threshold).alias("passes")
    )


def _products(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = HashedWords(DIMENSION)
        length = lambda x: np.sqrt((x * x).sum(1))
        last = own = said = counts = None
        for batch in batches:
            for tile, asked in zip(batch.column(0), batch.column(1), strict=True):
                if (now := tile.as_py()) != last:
                    last, own = now, unpacked(now)
                    vectors = provider.embed(own.column(2).to_pylist())
                    doc, idx, size = own.column(0).to_numpy(), own.column(1).to_numpy(), length(vectors)
                if (now := asked.as_py()) != said:
                    said, questions = now, unpacked(now)
                    counts = provider.embed(questions.column(1).to_pylist())
                    live = counts.any(1)
                    ids, counts = questions.column(0).to_numpy()[live], counts[live]
                if not len(ids):
                    continue
                # Products of counts are whole numbers, so this is exact before the one division.
                near = (counts @ vectors.T) / np.maximum(length(counts)[:, None] * size, 1e-300)
                row, col = best_places(near, k, doc, idx)
                some = near[row, col] > 0
                row, col = row[some], col[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(doc[col]), pa.array(idx[col].astype(np.int32)), pa.array(near[row, col])],
                    ["item_id", "doc_id", "chunk_idx", "similarity"],
                )

    return run
