"""Documents to overlapping windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X


def chunk(docs: DataFrame, size: int = X.CHUNK_WORDS, overlap: int = X.CHUNK_OVERLAP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_idx, content, word_count); blank documents have no rows. One scan, no shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(X.chunks(F.col(text), size, overlap)).alias("c")).select("doc_id", "c.chunk_idx", "c.content", "c.word_count")


def batches(counts: DataFrame, key: str, order: str, tokens: str, slots: int = 16, budget: int = 2048, longest: int = 2000) -> DataFrame:
    """(key, order, batch): sequences of a key, in order, into greedy batches of at most `slots` and `budget` tokens.

    A sequence counts `longest` tokens at most; one of none, or a null, takes a slot only. Null keys are one key; among equal
    places the smaller sequence comes first. A key's rows are sorted, on disk if need be, and passed once: what a task holds
    of a key is its open batch, however many sequences it has.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, filled, used = object(), 0, 0, 0
        for part in parts:
            out = []
            for of, n in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                n = min(max(n or 0, 0), longest)
                if of != last:
                    last, number, filled, used = of, 0, 0, 0
                elif filled >= slots or (n and filled and used + n > budget):
                    number, filled, used = number + 1, 0, 0
                filled, used = filled + 1, used + n
                out.append(number)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int32())], [key, order, "batch"])

    asked = counts.select(key, F.col(order).cast("int").alias(order), F.col(tokens).cast("long").alias("__tokens"))
    schema = T.StructType([*asked.schema.fields[:2], T.StructField("batch", T.IntegerType())])
    return asked.repartition(key).sortWithinPartitions(key, order, "__tokens").mapInArrow(run, schema)


def slices(chunks: DataFrame, size: int = 16) -> DataFrame:
    """Adds the slice of `size` consecutive chunks that each chunk falls in."""
    return chunks.withColumn("slice", F.floor(F.col("chunk_idx") / size).cast("int"))
