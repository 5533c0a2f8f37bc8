import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import embed
from corpusloom.functions import generation as G
from corpusloom.functions import text as X
from corpusloom.operators import ingest_status
from corpusloom.sources.extract import sanitize


def test_byte_repair_equals_the_byte_table(spark):
    draw = random.Random(6)
    parts = [b"a", b"\x80", b"\xc3", b"\xa9", b"\xe2", b"\x82", b"\xac", b"\xf0", b"\x9f", b"\x93", b"\x9a", b"\xed", b"\xa0", b"\xf4", b"\x90", b"\xc0", b"\xe0", b"\xff", b"\0", b"\n", b"\x1f", "é".encode(), "漢".encode(), "📚".encode()]
    rows = [(i, b"".join(draw.choice(parts) for _ in range(draw.randrange(14)))) for i in range(3000)]
    rows += [(9000, b""), (9001, None), (9002, ("x é 漢 📚 " * 60_000).encode()), (9003, ("x é 漢 📚 " * 60_000).encode() + b"\xff tail"), (9004, b"\x80" * 20_000)]
    found = dict(map(tuple, spark.createDataFrame(rows, "id long, data binary").select("id", X.sanitize_bytes(F.col("data"))).collect()))
    assert all(found[i] == (None if d is None else sanitize(d)) for i, d in rows)


def test_draws_follow_the_distribution_and_agree(spark):
    logits = [2.0, 1.0, 0.0, -9.0]
    n = 20_000
    kept = spark.range(n).select(F.col("id").alias("key"), F.posexplode(F.array(*map(F.lit, logits))).alias("token", "logit")).withColumn("rank", F.col("token") + 1)
    found = G.sampled_token(kept, temperature=0.5).groupBy("token").agg(F.count("*").alias("n"), F.max("p").alias("p")).collect()
    want = np.exp(np.array(logits) / 0.5)
    want /= want.sum()
    assert sum(r["n"] for r in found) == n
    for r in found:
        assert r["p"] == pytest.approx(want[r["token"]]) and abs(r["n"] / n - want[r["token"]]) < 4 * (want[r["token"]] / n) ** 0.5 + 1e-3
    again = G.sampled_token(kept.repartition(5, "token"), temperature=0.5)
    assert again.exceptAll(G.sampled_token(kept, temperature=0.5)).count() == 0
    other = G.sampled_token(kept, temperature=0.5, seed=7).select("key", "token")
    assert 0 < other.exceptAll(again.select("key", "token")).count() < n


def test_embedding_batches_and_failing_texts():
    sizes = [random.Random(i).choice([0, 1, 5, 300, 1500, 2500]) for i in range(400)]
    batches = list(embed.by_budget(sizes))
    assert sorted(i for b in batches for i in b) == [i for i, n in enumerate(sizes) if n]
    assert all(len(b) <= 16 and sum(min(sizes[i], 2000) for i in b) <= 2048 for b in batches)

    class Fussy(embed.HashedWords):
        calls: list = []

        def embed(self, texts):
            self.calls.append(sum(min(len(t.split()), 2000) for t in texts))
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return super().embed(texts)

    texts = [f"word{i} " * (i % 40 + 1) for i in range(1000)]
    texts[500], texts[7] = "a bad text", " "
    found, plain = embed.embedded(Fussy(64), texts), embed.unit(embed.HashedWords(64).embed(texts)).astype(np.float32)
    assert max(Fussy.calls) <= 2048 and not found[500].any() and not found[7].any()
    assert np.array_equal(np.delete(found, 500, 0), np.delete(plain, 500, 0))


def test_a_small_batch_shuffles_no_known_rows(spark, monkeypatch):
    monkeypatch.setattr(ingest_status, "BROADCAST_KNOWN", 50)
    known = spark.range(100_000_000).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("h"), "id").alias("content_hash"))
    incoming = spark.createDataFrame([("p1", "h1", True), ("p2", "new", True), ("q", "h9", True), ("r", "newer", True), ("s", "newer", True), ("t", None, False)], "path string, content_hash string, has_text boolean")
    plan = ingest_status.classify(incoming, known)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for at, line in enumerate(lines):
        if "Range (0, 100000000" in line:  # between the known rows and the first exchange there is a semi join with the batch
            above = [lines[k] for k in range(at, -1, -1) if depth[k] < depth[at] and depth[k] == min(depth[k : at + 1])]
            first = next(k for k, x in enumerate(above) if "Exchange" in x)
            assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in above[:first])
    small = known.filter("path < 'p2'").limit(2000).unionByName(spark.createDataFrame([("p2", "h2"), ("p9", "h9")], "path string, content_hash string")).dropDuplicates(["path"])
    found = {r["path"]: r["status"] for r in ingest_status.classify(incoming, small).collect()}
    monkeypatch.setattr(ingest_status, "BROADCAST_KNOWN", 1 << 30)
    assert found == {r["path"]: r["status"] for r in ingest_status.classify(incoming, small).collect()}
    assert found["p2"] == "modified" and found["q"] == "duplicate" and found["r"] == "fresh" and found["s"] == "duplicate" and found["t"] == "failed"
