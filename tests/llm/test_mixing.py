import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from corpusloom.llm import mixing


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water-filling by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(found, rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[2]] += words(r[1])
    target = filled(dict(sizes))
    source = {(r[0], words(r[1])): r[2] for r in rows}
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    return {s: (taken[s], target[s]) for s in sizes}


def test_targets_and_words_taken(documents):
    draw = random.Random(1)
    rows = [(i, " ".join("w" * draw.randint(1, 3) for _ in range(draw.choice([0, 1, 5, 40, 300]))), draw.choice(["a"] * 9 + ["b", "c", "d", "é", None])) for i in range(600)]
    found = mixing.mix_report(documents(rows)).collect()
    assert len(found) == len(rows)
    for taken, target in check(found, rows).values():
        assert abs(taken - target) <= 1
    assert sorted(map(tuple, mixing.mix_report(documents(rows[::-1]).repartition(5)).collect())) == sorted(map(tuple, found))


def test_odd_rows_and_empty(documents, odd_rows):
    found = mixing.mix_report(documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    assert all(r["taken"] <= 2 * r["size"] for r in found)
    assert mixing.mix_report(documents([])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix_report(documents([(1, None, None), (2, " ", "a")])).collect())


def test_rows_of_the_mix_have_the_words_taken(documents):
    rows = [(i, " ".join(f"w{k}" for k in range(10 + i % 3)) + " \n", "abc"[i % 3]) for i in range(90)]
    docs = documents(rows)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    want = sorted(r["taken"] for r in mixing.mix_report(docs).collect() if r["taken"])
    got = defaultdict(int)
    text = {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += words(r["text"])
    assert sorted(got.values()) == want


def test_rows_taken_equal_a_walk_in_hash_order(documents):
    """Each source's rows in the order of their draw, rows of one id together, until the words left are met."""
    draw = random.Random(5)
    rows = [(draw.randrange(700), "w " * draw.randint(0, 30), draw.choice(["a"] * 6 + ["b", "c", None])) for _ in range(900)]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    target, want = filled(dict(sizes)), []
    for source, size in sizes.items():
        whole, left = divmod(math.floor(target[source] + 0.5), size)
        drawn = defaultdict(list)
        for doc_id, text, of in rows:
            if of == source:
                drawn[hashlib.md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest(), doc_id].append(words(text))
        for (_, doc_id), group in sorted(drawn.items()):
            met = min(left, sum(group))
            want += [(doc_id, n, whole * n + (n * met // sum(group) if met else 0)) for n in group]
            left -= met
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_report(documents(rows)).collect()) == sorted(want)
