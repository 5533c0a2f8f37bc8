import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash as S


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, radius=3):
    up = {p: p for p in prints}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {p: top(p) for p in prints}


def test_masks_cover_every_pair_within_the_radius():
    masks = S.covering_masks()
    assert len(masks) == 15
    for bits in itertools.chain(*(itertools.combinations(range(64), r) for r in (1, 2, 3))):
        differ = sum(1 << b for b in bits)
        assert any(not differ & m for m in masks)


def test_buckets_of_any_size(monkeypatch):
    draw = random.Random(1)
    mask = S.covering_masks()[0]
    free = [b for b in range(64) if not mask >> b & 1]
    members = np.array(sorted({sum(1 << b for b in draw.sample(free, draw.randint(0, 6))) for _ in range(300)}), np.uint64)
    want = roots([int(m) for m in members])
    for most in (4096, 10):
        monkeypatch.setattr(S, "_COMPARED", most)
        label = S.bucket_components(members, mask)
        assert {int(m): int(members[k]) for m, k in zip(members, label, strict=True)} == want


def near(draw, n):
    rows = []
    for i in range(n):
        if rows and draw.random() < 0.5:
            words = draw.choice(rows)[1].split()
            words[draw.randrange(len(words))] = "changed"
        else:
            words = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 60, 300]))]
        rows.append((1000 - i, " ".join(words)))
    return rows


def test_equals_brute_force(documents):
    rows = near(random.Random(3), 250) + [(2000, None), (2001, ""), (2002, " \t")]
    prints = {i: plain_print(t) for i, t in rows}
    root = roots(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    found = S.near_duplicates(documents(rows).repartition(6)).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in found} == {i: (p, least[root[p]]) for i, p in prints.items()}
    assert all(len(r["fingerprint"]) == 16 for r in found)
    kept = S.drop_near_copies(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (901, 900), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in S.components(links).collect()}
    assert found == {k: 0 for k in range(301)} | {900: 900, 901: 900}


def test_odd_rows_and_empty(documents, odd_rows):
    found = S.near_duplicates(documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {1}
    docs = documents(odd_rows)
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["component_id"] for r in found})
    assert S.near_duplicates(documents([])).count() == 0


def test_hash_is_sparks(spark):
    text = "a bc déf"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text, 42)
