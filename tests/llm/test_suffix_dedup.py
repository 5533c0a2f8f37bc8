import hashlib
import random
import re

import numpy as np
import pytest

from corpusloom.llm import suffix_dedup as S


def brute(rows):
    """Rows in the order of ids, nulls last, then the table's."""
    seen, out = set(), []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = hash(b[p : p + 100])
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def mixture(seed, n=60):
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choice("abcdefgh é") for _ in range(k))
    shared = [text(k) for k in (99, 100, 101, 150, 400, 1500)]
    rows = []
    for i in range(n):
        parts = [draw.choice([text(draw.randint(0, 300)), draw.choice(shared), "=" * draw.randint(1, 260), "ab" * draw.randint(1, 120)]) for _ in range(draw.randint(0, 4))]
        if i % 7 == 3 and rows:
            old = draw.choice(rows)[1]
            cut = draw.randint(0, len(old))
            parts = [old[:cut], draw.choice("xyz"), old[cut:]]
        rows.append((draw.randint(0, 10**6) * 100 + i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(documents, seed):
    rows = mixture(seed)
    assert found(S.remove_repeats(documents(rows).repartition(5 if seed % 2 else 1, "doc_id"))) == brute(rows)


def test_odd_rows(documents, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None or r[1] is None] + [(None, "q" * 300)]
    assert found(S.remove_repeats(documents(rows).coalesce(1))) == brute(rows)
    assert S.remove_repeats(documents([])).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 700)
    texts = [t.encode() for _, t in mixture(11, 40)]
    whole = S._joined([S._samples(c) for c in S._chunks(texts)])
    monkeypatch.setattr(S, "CHUNK", 1 << 20)
    want = S._joined([S._samples(c) for c in S._chunks(texts)])

    def pack(x):  # a sample at a piece's end has its strings in two pieces
        columns = (x[k].tolist() for k in ("row", "pos", "before", "size", "gram"))
        return sorted((r, p + k, b - k, g) for r, p, b, n, g in zip(*columns, strict=True) for k in range(n))

    assert pack(whole) == pack(want)


def test_family_keeps_the_earliest():
    draw = np.random.default_rng(1)
    family, gone, best = S.LevelFamily(), [], {}
    for _ in range(40):
        keys = np.unique(draw.integers(0, 300, 30)).astype(np.uint64)
        doc = draw.integers(0, 10**6, len(keys))
        batch = {"key": keys, "check": keys, "doc": doc, "row": doc, "pos": doc}
        gone += family.add(batch)["doc"].tolist()
        for k, d in zip(keys.tolist(), doc.tolist(), strict=True):
            best.setdefault(k, []).append(d)
    sizes = [len(x["key"]) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    left = family.all()
    assert dict(zip(left["key"].tolist(), left["doc"].tolist(), strict=True)) == {k: min(v) for k, v in best.items()}
    assert sorted(gone) == sorted(d for v in best.values() for d in sorted(v)[1:])


def test_kept_bytes(documents):
    a = "".join(chr(97 + k * 7 % 26) + chr(97 + k * k % 23) for k in range(120))
    kept = {r["doc_id"]: bytes(r["kept"]) for r in S.kept_bytes(documents([(1, a), (2, "x" + a + "y")])).collect()}
    assert kept == {1: a.encode(), 2: b"xy"}


def test_strings_that_plain_polynomials_confuse(documents):
    """Thue-Morse strings and their complements share their sums of bytes times powers modulo 2^64, whatever the odd base."""
    word = "a"
    while len(word) < 512:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice([word[:256], other[:256], word, other, "x", "yz"]) for _ in range(3))) for i in range(30)]
    assert found(S.remove_repeats(documents(rows))) == brute(rows)
    both = np.frombuffer((word + other).encode(), np.uint8)
    assert len({int(S.Rolling(both, k).ranges(np.array([a]), np.array([a + 512]))[0]) for k in (0, 1) for a in (0, 512)}) == 4


def test_bytes_decide_where_hashes_agree(documents, monkeypatch):
    """With hashes of three values, samples and parts meet for no reason; only equal bytes go."""
    plain = S._mixed
    monkeypatch.setattr(S, "_mixed", lambda h: plain(h) % np.uint64(3) << np.uint64(40))
    rows = mixture(5, 25)
    texts = [(t or "").encode() for _, t in sorted(rows)]
    batch = S.pa.RecordBatch.from_pydict({"row": list(range(len(texts))), "doc_id": [i for i, _ in sorted(rows)], "text": [t.decode() for t in texts]})
    first = list(S._settle_grams(S._index_grams(4)(iter([batch.slice(0, 9), batch.slice(9)]))))
    first = [r for b in first for r in b.to_pylist()]
    places = [sorted({r["a"] << 16 | r["b"] for r in first if r["kind"] == S._EDGE and r["row"] == i}) for i in range(len(texts))]
    places = S.pa.array(places, S.pa.list_(S.pa.int64()))
    contexts = S._index_contexts(4)(iter([batch.append_column("places", places)]))
    second = [r for b in S._settle_contexts(contexts) for r in b.to_pylist()]
    spans = [[{"a": r["a"], "b": r["b"]} for r in first + second if r["kind"] == S._SPAN and r["row"] == i] for i in range(len(texts))]
    got = [(n, r, k, hashlib.sha256(kept).hexdigest()) for n, r, k, kept in S._cut(texts, spans)]
    assert sorted((str(i), *g) for (i, _), g in zip(sorted(rows), got, strict=True)) == brute(rows)


def test_zeros_and_batches_of_the_family(documents, monkeypatch):
    """Zero bytes at ends of keys, and levels that merge often."""
    monkeypatch.setattr(S, "SORTED", 7)
    draw = random.Random(8)
    zeros = ["\0" * k for k in (1, 40, 99, 100, 143, 200)]
    shared = ["".join(draw.choice("ab\0") for _ in range(k)) for k in (100, 130, 300)]
    rows = [(i, "".join(draw.choice([*zeros, *shared, "q", draw.choice(shared)[: draw.randint(50, 299)]]) for _ in range(3))) for i in range(40)]
    assert found(S.remove_repeats(documents(rows).repartition(3))) == brute(rows)
