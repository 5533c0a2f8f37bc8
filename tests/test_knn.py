import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import knn, retrieval, tiles


def brute(q, c, k):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(unit(q) @ unit(c).T, knn.DIGITS)
    return {(i, r + 1, int(j)) for i in range(len(q)) for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-near[i, j], j))[:k])}


def test_tiles_equal_brute_force(spark, monkeypatch):
    """Queries in many tiles, sent to all tasks and dealt to groups; with repeated vectors."""
    draw = np.random.default_rng(5)
    c = draw.integers(-3, 4, (300, 6)).astype(float)
    c[(c == 0).all(1)] = 1
    q = np.concatenate((c[::3], draw.normal(size=(40, 6))))
    frame = lambda x, name: spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], f"{name} long, embedding array<double>, v string")
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "TILE", 37)
    for most in (tiles.BROADCAST_BYTES, 0):
        monkeypatch.setattr(tiles, "BROADCAST_BYTES", most)
        found = knn.search(frame(q, "query_id").repartition(3), frame(c, "vec_id").repartition(5), 4)
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()} == brute(q, c, 4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan


def test_corpus_is_scanned_once(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 8)
    seen = spark.sparkContext.accumulator(0)
    corpus = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    queries = corpus.withColumnRenamed("vec_id", "query_id")
    found = knn.search(queries, corpus.mapInArrow(count, corpus.schema), 1)
    assert found.count() == 200 and seen.value == 200


def test_questions_in_many_tiles(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i} beta{i % 7} gamma") for i in range(60)] + [(99, " "), (98, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"alpha{i} beta{i % 7}") for i in range(50)] + [(77, ""), (78, None), (79, "unknown words")], "item_id long, text string")
    want = sorted(map(tuple, retrieval.retrieve(docs, asked, 2).collect()))
    assert {r[0] for r in want if r[1] == 1 and r[2] == r[0]} == set(range(50)) and not any(r[0] in (77, 78, 79) for r in want)
    monkeypatch.setattr(retrieval, "BLOCK", 9)
    monkeypatch.setattr(retrieval, "TILE", 7)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, retrieval.retrieve(docs, asked, 2).collect())) == want


def test_a_pair_of_full_tiles_takes_little_memory():
    draw = np.random.default_rng(3)
    q, c = draw.normal(size=(knn.BLOCK, 8)), draw.normal(size=(knn.TILE, 8))

    def tile(x):
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.array(range(len(x))), pa.array(list(x))], ["id", "v"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    pair = pa.record_batch([pa.array([tile(c)], pa.binary()), pa.array([tile(q)], pa.binary())], ["corpus", "queries"])
    tracemalloc.start()
    found = pa.Table.from_batches(knn._products(4, 8)(iter([pair]))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    place = np.arange(4 * knn.BLOCK) % 4 + 1
    assert set(zip(found["query_id"], place.tolist(), found["vec_id"], strict=True)) == brute(q, c, 4)
    assert peak < 64 << 20
