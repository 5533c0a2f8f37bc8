"""Schemas of the stored relations and of what the plans return."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("content_hash", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

CHUNKS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("chunk_idx", T.IntegerType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), True),
])

#: What extraction makes of a file: its text, or the reason why there is none.
EXTRACTED = "path string, content_hash string, text string, error string"
