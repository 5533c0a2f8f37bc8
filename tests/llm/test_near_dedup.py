import itertools
import random
import time

import corpus_pipeline
import numpy as np
import pytest

from corpusloom.llm import near_dedup as N
from corpusloom.llm import simhash
from tests.llm.test_simhash import roots


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def kept_ids(rows):
    """Brute force over all pairs: the smallest id of each component."""
    sets = {i: plain_shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            x, y = sorted((top(i), top(j)))
            up[y] = x
    return sorted({top(i) for i in up})


def edited(draw):
    """Texts with a common passage, copies at similarities on both sides of 0.8, and one large group of near copies."""
    passage = [f"p{i}" for i in range(30)]
    rows = [(1, ""), (2, " \t"), (3, "one two"), (4, "One  two")]
    for i in range(60):
        base = [f"w{draw.randint(0, 300)}" for _ in range(draw.choice([6, 40, 150, 300]))]
        if i % 3 == 0:
            base[3:3] = passage
        rows.append((10 + 10 * i, " ".join(base)))
        for k in range(1, 5):
            words = list(base)
            for _ in range(draw.randint(1, max(1, len(words) // 20))):
                words[draw.randrange(len(words))] = f"new{draw.randint(0, 10**6)}"
            rows.append((10 + 10 * i + k, " ".join(words)))
    large = [f"g{i}" for i in range(120)]
    for k in range(150):
        words = list(large)
        for _ in range(draw.randint(1, 4)):
            words[draw.randrange(120)] = f"x{k}"
        rows.append((5000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("cluster", [1 << 19, 2000])
def test_equals_brute_force(documents, monkeypatch, cluster):
    monkeypatch.setattr(N, "CLUSTER", cluster)
    rows = edited(random.Random(7))
    found = sorted(r["doc_id"] for r in N.drop_near_copies(documents(rows)).collect())
    assert found == kept_ids(rows)


def test_stage_finds_copies_that_fingerprints_miss(spark, documents, tmp_path):
    rows = edited(random.Random(8))
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    root = roots(set(prints.values()))
    want = kept_ids(rows)
    assert len(want) < len({root[p] for p in prints.values()})
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_odd_rows_and_empty(documents, odd_rows):
    kept = N.drop_near_copies(documents(odd_rows))
    assert kept.columns == documents(odd_rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "8", "9"]
    assert N.drop_near_copies(documents([])).count() == 0


def near_copies(n, words, seed):
    """Sets of shingles of n texts, each with a few shingles of its own."""
    draw = np.random.default_rng(seed)
    base = draw.integers(1, 1 << 62, words).astype(np.uint64)
    return [np.unique(np.concatenate((base[draw.permutation(words)[: words - 2]], draw.integers(1, 1 << 62, 2).astype(np.uint64)))) for _ in range(n)]


def test_a_bucket_of_thousands_of_near_copies_is_quick():
    sets = near_copies(8_000, 60, 1)
    prints = np.array([N.sketch(s) for s in sets])
    began = time.monotonic()
    ties = list(N._gathered(np.array(list(map(len, sets))), prints))
    assert sum(len(x) for _, x in ties) == 7_999 and time.monotonic() - began < 5
    began = time.monotonic()
    links = list(N.linked(sets))
    assert sum(len(x) for _, x in links) == 7_999 and time.monotonic() - began < 10


def test_gathered_equals_all_pairs():
    draw = random.Random(3)
    sets = [s for k in range(12) for s in near_copies(draw.randint(1, 9), draw.choice([8, 30, 90]), k)]
    draw.shuffle(sets)
    n, prints = np.array(list(map(len, sets))), np.array([N.sketch(s) for s in sets])

    def parts(edges):
        up = list(range(len(sets)))
        for i, j in edges:
            x, y = up[i], up[j]
            up = [x if u == y else u for u in up]
        return sorted(sorted(i for i in range(len(sets)) if up[i] == u) for u in set(up))

    near = lambda i, j: min(n[i], n[j]) * 5 >= 4 * max(n[i], n[j]) and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= N.FAR
    pairs = list(itertools.combinations(range(len(sets)), 2))
    assert parts((i, int(j)) for i, js in N._gathered(n, prints) for j in js) == parts(p for p in pairs if near(*p))
    similar = lambda i, j: 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (n[i] + n[j])
    assert parts((i, int(j)) for i, js in N.linked(sets) for j in js) == parts(p for p in pairs if similar(*p))


def test_tables_of_fingerprints_tie_near_copies_by_themselves(spark):
    """Without any first shingle: up to 15 differing bits for sure, and most pairs that are just similar enough."""
    draw = random.Random(4)
    sets = [s for k in range(40) for s in near_copies(2, 60, k)]
    prints = [N.sketch(s) for s in sets]
    for _ in range(60):
        one = draw.getrandbits(256)
        prints += [np.frombuffer(x.to_bytes(32, "little"), np.uint64) for x in (one, one ^ sum(1 << b for b in draw.sample(range(256), 15)))]
    rows = [(i, 60, 0, 0, *p.view(np.int64).tolist(), []) for i, p in enumerate(prints)]
    ties = N._candidates(spark.createDataFrame(rows, N._PRINT), N.table_keys(len(rows))).collect()
    found = {tuple(sorted((r["a"], r["b"]))) for r in ties}
    assert found <= {(i, i + 1) for i in range(0, len(rows), 2)}
    assert found >= {(i, i + 1) for i in range(len(sets), len(rows), 2)}
    assert sum((i, i + 1) in found for i in range(0, len(sets), 2)) >= 38
