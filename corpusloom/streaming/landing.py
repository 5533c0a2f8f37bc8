"""An append-only landing zone: new rows of text go through the same merge as files, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import Config
from corpusloom.functions.embed import HashedWords
from corpusloom.functions.hashing import content_hash
from corpusloom.functions.text import not_blank, sanitize_controls
from corpusloom.operators.store import Index
from corpusloom.plans.ingest import merge


def ingest_rows(index: Index, rows: DataFrame, config: Config, embedder=HashedWords):
    """Merges rows (path, text); of a path that comes twice in a batch the larger text counts."""
    one = rows.groupBy("path").agg(F.max("text").alias("text"))
    one = one.withColumn("content_hash", content_hash(F.col("text"))).withColumn("has_text", not_blank(F.col("text")))
    texts = one.select("path", sanitize_controls(F.col("text")).alias("text"), F.lit(None).cast("string").alias("error"))
    return merge(index, one.select("path", "content_hash", "has_text"), texts, config, embedder)


def ingest_stream(stream: DataFrame, config: Config, checkpoint: str, embedder=HashedWords, **trigger) -> StreamingQuery:
    """Starts ingesting a stream of (path, text). A repeated micro-batch changes nothing, for its hashes are known."""
    trigger = trigger or {"availableNow": True}

    def batch(rows: DataFrame, _: int) -> None:
        index = Index(rows.sparkSession, config.index_path, config.embed_dimension).open()
        ingest_rows(index, rows.select("path", "text"), config, embedder)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
