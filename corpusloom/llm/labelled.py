"""Bounded labelled samples and small models fitted on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import held_out, written

#: Labelled rows that a classifier is fitted on at most; its choice depends on ids alone.
MAX_TRAINING_ROWS = 20_000
_AT_ONCE = 512


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = MAX_TRAINING_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(text, label) of at most `rows` labelled ids, as a written table; held-out folds never enter, and equal texts with
    equal labels enter once, so that copies prove no more than one.

    Rows with a null id or label are left out; of several labels of an id the larger counts. Ids are taken by the order of
    a hash, so the choice is the same for any partitioning. The ids are few by that bound, hence the broadcast.
    """
    wanted = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).dropna().filter(~held_out(F.col("id")))
    ids = wanted.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(rows)
    sample = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return written(sample.select("text", "label").distinct(), f"sample-{label}")


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; put a column of ones into x for an intercept."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    scale = weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) / scale + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / scale + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def with_scores(docs: DataFrame, name: str, text: str, scores: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """`docs` with a column of scores of its texts, in one pass and without a shuffle. Whole rows go through Arrow, so the
    JVM keeps none of them waiting for an answer; texts become Python strings a few at a time."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            found = [scores(texts.slice(at, _AT_ONCE).to_pylist()) for at in range(0, batch.num_rows, _AT_ONCE)]
            yield batch.append_column(name, pa.array(np.concatenate([np.zeros(0), *found]), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
