"""Two tables side by side in tiles, for joins that compare every query with every row.

Rows are packed into tiles of a bounded number of rows, one binary value each. Every tile of the one table meets every tile of
the other in some task, which then compares them by a matrix product. Both tables are scanned once, whatever their sizes. Few
queries are sent to all tasks, behind a check of their bytes; beyond, the corpus is dealt to groups and every group gets all
queries, so that tiles of the corpus move once and are never copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tables import partitions

#: Bytes of packed queries up to which they are sent to all tasks.
BROADCAST_BYTES = 32 << 20


def packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """The rows of a table in tiles of at most `rows` rows: a column `name` of Arrow's stream format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def tile() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == rows:
                    yield tile()
                    held, count = [], 0
        if held:
            yield tile()

    return df.mapInArrow(run, f"{name} binary")


def unpacked(tile: bytes) -> pa.RecordBatch:
    found = pa.ipc.open_stream(tile).read_all().combine_chunks()
    return found.to_batches()[0]


def pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(corpus, queries): every pair of a tile of `corpus` and one of `queries`, a written table. Pairs of one corpus tile come
    one after the other."""
    size = queries.agg(F.coalesce(F.sum(F.octet_length("queries")), F.lit(0))).first()[0]
    groups = 1 if size <= BROADCAST_BYTES else partitions(queries.sparkSession)
    asked = queries.withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = corpus.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.join(F.broadcast(asked) if groups == 1 else asked, "__group").select("corpus", "queries")
