"""Files into the index."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.functions.embed import HashedWords, embed_column
from corpusloom.functions.hashing import content_hash
from corpusloom.functions.text import chunks as chunked
from corpusloom.operators import ingest_status
from corpusloom.operators.numbering import running
from corpusloom.operators.store import BUCKETED, Conflict, Index, by_bucket, changed_documents
from corpusloom.sources.extract import extract_contents, extract_files, hash_files
from corpusloom.sources.files import contents, list_files, opens
from corpusloom.functions.paths import clean_path

#: Times that a merge begins anew because another writer published a version first.
ATTEMPTS = 5


@dataclass(frozen=True)
class Report:
    files: int
    docs: int
    chunks: int
    skipped: int
    failed: int
    seconds: float


def ingest(spark: SparkSession, path: str, config: Config | None = None, embedder=HashedWords) -> Report:
    """Every supported file under a path or URI into the index that the settings name."""
    began, config = time.monotonic(), config or Config()
    if opens(clean_path(path)):
        return ingest_files(spark, list_files(spark, path), config, embedder)
    whole = contents(spark, path)  # only Spark's own reader opens it
    hashed = whole.select("path", content_hash(F.col("content")).alias("content_hash"))
    index = Index(spark, config.index_path, config.embed_dimension).open()
    return merge(index, hashed.withColumn("has_text", F.lit(True)), lambda work: extract_contents(work.join(whole, "path")), config, embedder, began)


def ingest_files(spark: SparkSession, files: DataFrame, config: Config, embedder=HashedWords) -> Report:
    """The files (path) of a table."""
    began = time.monotonic()
    index = Index(spark, config.index_path, config.embed_dimension).open()
    return merge(index, hash_files(files).withColumn("has_text", F.col("content_hash").isNotNull()), extract_files, config, embedder, began)


def merge(index: Index, incoming: DataFrame, texts, config: Config, embedder=HashedWords, began: float | None = None) -> Report:
    """Classifies (path, content_hash, has_text), extracts only what is new, and publishes the next version, which writes rows of
    the documents that change and no others; where nothing is new or changed, nothing is written.

    `texts` makes (path, text, error) of the (path, content_hash) that need work, or is such a table. The lookup against known
    hashes comes before extraction, for no filter moves across a Python stage by itself. Chunks of a changed document are
    replaced; a duplicate gets a document row and no chunks; failed ones leave no trace, so the next run tries them again.
    Where another writer publishes a version meanwhile, the merge begins anew from that.
    """
    began = began or time.monotonic()
    held = [incoming.persist()]
    try:
        for attempt in range(ATTEMPTS):
            try:
                return _merge(index, held[0], texts, config, embedder, began)
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
    finally:
        held[0].unpersist()


def _merge(index: Index, incoming: DataFrame, texts, config: Config, embedder, began: float) -> Report:
    base = index.at()
    held = [ingest_status.classify(incoming, base.documents(), keep=("id", "created_at")).persist()]
    status = held[0]
    try:
        work = status.filter("status IN ('fresh', 'modified')").select("path", "content_hash")
        read = work.join(texts.select("path", "text", "error"), "path") if isinstance(texts, DataFrame) else texts(work)
        # Texts are cut into chunks once; counts and ids come from what is kept.
        pieces = F.when(F.col("text").isNotNull(), chunked(F.col("text"), config.chunk_size_words, config.chunk_overlap_words))
        read = read.select("path", "content_hash", pieces.alias("pieces")).persist()
        held.append(read)
        good = read.filter("pieces IS NOT NULL")
        counted = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
        done = {r["ok"]: r["n"] for r in read.groupBy(F.col("pieces").isNotNull().alias("ok")).agg(F.count("*").alias("n")).collect()}
        skipped = counted.get("unchanged", 0) + counted.get("duplicate", 0)
        report = lambda stored: Report(
            sum(counted.values()), done.get(True, 0), stored, skipped, counted.get("failed", 0) + done.get(False, 0), time.monotonic() - began
        )
        if not done.get(True) and not counted.get("duplicate"):
            return report(0)  # nothing to write: the live version stays
        sizes = good.select("path", "content_hash", F.size("pieces").alias("n")).unionByName(
            status.filter("status = 'duplicate'").select("path", "content_hash", F.lit(0).alias("n"))
        )
        known = status.filter("id IS NOT NULL").select("path", "id", F.col("known_hash").alias("content_hash"), "created_at")
        documents = changed_documents(known, sizes, F.lit(base.high("documents")).cast("long")).join(sizes.select("path", "n"), "path").persist()
        held.append(documents)
        # Ids of chunks follow the document and the place in it, after the highest there has been.
        starts = running(documents.select("id", "path", "n"), "id", "until", "n")
        placed = starts.join(good.select("path", "pieces"), "path").select(F.col("id").alias("doc_id"), (F.col("until") - F.col("n")).alias("before"), F.explode("pieces").alias("c"))
        number = F.lit(base.high("chunks")).cast("long") + F.col("before") + F.col("c.chunk_idx") + 1
        numbered = placed.select(number.alias("id"), "doc_id", "c.chunk_idx", "c.content")
        if done.get(True, 0) + counted.get("duplicate", 0) >= BUCKETED:  # dealt before they have vectors
            numbered = by_bucket(numbered)
        new = numbered.select("id", "doc_id", "chunk_idx", "content", embed_column(F.col("content"), embedder, config.embed_dimension).alias("embedding"))
        replaced = documents.filter("NOT is_new").select(F.col("id").alias("doc_id"))
        return report(base.append(documents, new, replaced).chunks)
    finally:
        for frame in held:
            frame.unpersist()
