import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(P.default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F, exclude_categories=("Cs",)), st.sampled_from(" \n\t'sé📚\u2003\u200bأ中"))))
def test_encoder_equals_the_tokenizer(text):
    t = P.encoder(P.default_tokenizer())
    assert np.frombuffer(t(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_on_special_text(tokenizer):
    text = "a<|endoftext|>b"
    assert np.frombuffer(P.encoder(P.default_tokenizer())(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_cut():
    assert P.cut(1) == [(0, 1)] and P.cut(2048) == [(0, 2048)] and P.cut(4100) == [(0, 4), (4, 2048), (2052, 2048)]


def check(found, rows, tokenizer):
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[str(i)].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    want = sorted((i, k, s, n, zlib.crc32(x[s : s + n].tobytes())) for i, xs in ids.items() for x in xs for k, (s, n) in enumerate(P.cut(len(x))))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    return len(bins), -(-sum(r["length"] for r in found) // P.CAPACITY)


def test_odd_rows(documents, odd_rows, tokenizer):
    rows = odd_rows + [(30 + i, "some words here " * (i * 37 % 500)) for i in range(80)]
    used, least = check(P.pack_documents(documents(rows).repartition(3)).collect(), rows, tokenizer)
    assert used == least
    assert P.pack_documents(documents([])).count() == 0


def test_local_search_empties_bins():
    draw = random.Random(5)
    better = 0
    for _ in range(60):
        lengths = [draw.randint(1, 100) for _ in range(draw.randint(5, 80))]
        loose = [[i] for i in range(len(lengths))]
        for start in (P.best_fit(lengths, 100), loose):
            done = P.local_search([list(b) for b in start], lengths, 100)
            assert sorted(i for b in done for i in b) == list(range(len(lengths)))
            assert all(sum(lengths[i] for i in b) <= 100 for b in done) and len(done) <= len(start)
            better += len(done) < len(start)
    assert better >= 60


def test_exchanges_find_what_moves_cannot():
    """The last bin's 4 fits nowhere; exchanged for a 2, both other bins fill up."""
    assert len(P.local_search([[0, 1], [2, 3], [4]], [6, 2, 5, 3, 4], 10)) == 2


def test_two_for_one():
    """Neither 3 nor 2 is of use alone; both for the 4 fill the first bin, and the 4 has room in the second."""
    bins, size = [[0, 1], [2], [3, 4]], np.array([5, 4, 6, 3, 2])
    fill = np.array([9, 6, 5])
    assert P._step(bins, size, fill, 2, np.array([0]), 10)
    assert sorted(map(sorted, bins)) == [[0, 3, 4], [1], [2]] and fill.tolist() == [10, 6, 4]


def test_search_ends_where_the_bound_is_out_of_reach():
    draw = random.Random(12)
    sets = [[draw.randint(1000, 1400) for _ in range(6000)], [1025] * 16_384, [draw.choice([683, 700, 1025, 1100, 1366]) for _ in range(16_384)]]
    for lengths in sets:
        start = P.best_fit(lengths)
        began = time.process_time()
        done = P.local_search([list(b) for b in start], lengths)
        assert time.process_time() - began < 20
        assert P.least_bins(lengths) <= len(done) <= len(start)
        assert sorted(i for b in done for i in b) == list(range(len(lengths)))


def test_bound_is_never_above_the_best():
    draw = random.Random(13)
    for _ in range(200):
        capacity, lengths = 20, []
        for _ in range(draw.randint(1, 6)):  # bins that are full
            cuts = sorted(draw.sample(range(1, 20), draw.randint(1, 4)))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 20])]  # noqa: B905
        assert P.least_bins(lengths, capacity) == sum(lengths) // capacity
    assert P.least_bins([11, 11, 11, 3], 20) == 3 and P.least_bins([12, 12, 7, 7, 7], 20) == 3 and P.least_bins([], 20) == 0


def three_a_bin(seed, bins=40):
    """Lengths that fill 40 bins to 2,023 tokens on average."""
    draw, lengths = random.Random(seed), []
    for _ in range(bins):
        top = P.CAPACITY - draw.randint(0, 50)
        cuts = sorted(draw.sample(range(300, 1700), 2))
        lengths += [b - a for a, b in zip([0, *cuts], [*cuts, top])]  # noqa: B905
    return lengths


def test_search_beats_best_fit_on_the_query_s_path(spark):
    lengths = next(x for x in map(three_a_bin, range(100)) if len(P.best_fit(x)) == 41)
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = P.pack(rows).collect()
    assert sorted(r["length"] for r in found) == sorted(lengths)
    assert len({r["sequence_id"] for r in found}) == 40
