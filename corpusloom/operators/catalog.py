"""Listings of what an index holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.numbering import numbered

PAGE = 15


def list_documents(documents: DataFrame, chunks: DataFrame, pattern: str | None = None, limit: int = 0) -> DataFrame:
    """(id, path, content_hash, chunk_count) by id; documents without chunks count 0. A limit below 1 means all.

    Chunks are counted before the join, so the join sees one row per document.
    """
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    if pattern:
        documents = documents.filter(X.ilike_contains(F.col("path"), pattern))
    listed = documents.join(counts, F.col("id") == F.col("doc_id"), "left").select(
        "id", "path", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce("n", F.lit(0)).alias("chunk_count")
    )
    return listed.orderBy("id").limit(limit) if limit > 0 else listed.orderBy("id")


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (documents, chunks)."""
    a, b = documents.agg(F.count("*").alias("documents")), chunks.agg(F.count("*").alias("chunks"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def document_chunks(chunks: DataFrame, doc_id: int, limit: int = 0) -> DataFrame:
    """(chunk_idx, word_count, content) of one document in order."""
    found = chunks.filter(F.col("doc_id") == doc_id).select("chunk_idx", X.word_count(F.col("content")).alias("word_count"), "content").orderBy("chunk_idx")
    return found.limit(limit) if limit > 0 else found


def resolve(documents: DataFrame, wanted: str) -> int | None:
    """The id that an argument names: itself if it is a number, else the lowest of the documents whose path matches."""
    if wanted.isascii() and wanted.isdigit():
        return int(wanted)
    first = documents.filter(X.ilike_contains(F.col("path"), wanted)).agg(F.min("id")).first()
    return first[0]


def owners(documents: DataFrame) -> DataFrame:
    """(content_hash, id, copies): the lowest id of each hash; documents without a hash own none."""
    return documents.filter("content_hash <> ''").groupBy("content_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def find_by_path(documents: DataFrame, path: str) -> int | None:
    row = documents.filter(F.col("path") == path).select("id").first()
    return row[0] if row else None


def find_by_hash(documents: DataFrame, content_hash: str) -> int | None:
    """The lowest id with this hash."""
    return documents.filter(F.col("content_hash") == content_hash).agg(F.min("id")).first()[0]


def hash_of(documents: DataFrame, path: str) -> str | None:
    """The hash of a path; None where the path is unknown or has no hash."""
    row = documents.filter(F.col("path") == path).select(F.nullif("content_hash", F.lit(""))).first()
    return row[0] if row else None


def paged(listed: DataFrame, key: str, size: int = PAGE) -> DataFrame:
    """Adds row numbers by the key and the page each falls on."""
    return numbered(listed, key).withColumn("page", F.ceil(F.col("rn") / size).cast("int"))
