import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    """rows of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            ws = [w for w in re.split("[ \t]", piece) if w]
            n[lang or "und"] += len(ws)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: c for p, c in counts.items() if c >= least}
        found = []
        for p, a in kept.items():
            if len(p) < 2 or any(c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in kept.items() if len(q) > len(p)):
                continue
            score, k = min((1000 * a * n[lang] // (kept[p[:k]] * kept[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), kept[p[:k]], kept[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def texts(seed, words, n, length):
    draw = random.Random(seed)
    names = ["a", "b", "The", "the", "é", "x1", "\x01", "漢"][:words]
    gap = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b", "!?"]
    return ["".join(draw.choice(names) + draw.choice(gap) for _ in range(draw.randrange(length))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, lang, text, 1, "p", "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, part string, phrase string")

    return make


@pytest.mark.parametrize("split", [1 << 19, 16])
def test_equals_brute_force(table, monkeypatch, split):
    """Also with words that several parts share."""
    monkeypatch.setattr(phrases, "SPLIT", split)
    monkeypatch.setattr(phrases, "PART_WORDS", 64)
    rows = [(lang, t) for k, lang in enumerate(["en", None, "de"]) for t in texts(k, 4 + 2 * k, 60, 40)]
    rows += [("en", "a a a a a a a a"), ("en", None), (None, ""), ("de", " \t\n "), ("en", "one two three four five six " * 9), ("en", "One Two Three Four Five Six")] * 3
    assert rows_of(phrases.collocations(table(rows), least=7)) == brute(rows, 7)


def test_places_that_words_share(table, monkeypatch):
    """A table of few places orders words otherwise; counts stay."""
    monkeypatch.setattr(phrases, "PLACES", 3)
    rows = [("en", t) for t in texts(9, 8, 80, 40)]
    assert rows_of(phrases.collocations(table(rows), least=4)) == brute(rows, 4)


def test_limits_and_empty_tables(table):
    rows = [("en", t) for t in texts(5, 8, 80, 60)]
    assert rows_of(phrases.collocations(table(rows), top=5, least=3)) == brute(rows, 3, 5)
    assert phrases.collocations(table([])).count() == 0
    assert phrases.collocations(table([("en", "too few words")] * 3)).count() == 0


def test_long_texts_go_in_slices(table, monkeypatch):
    monkeypatch.setattr(phrases, "PORTION", 64)
    rows = [("en", "".join(texts(3, 5, 40, 40))), ("en", "no delimiter at all " * 40), *(("en", t) for t in texts(4, 5, 20, 30))]
    assert rows_of(phrases.collocations(table(rows), least=5)) == brute(rows, 5)


def test_stretches():
    rank = np.array([3, 1, 2, 2, -1, 0, 5, 6, 7, 8, 9], np.int32)
    left, right = phrases._stretches(rank)
    assert left.tolist() == [0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0] and right.tolist() == [0, 2, 1, 0, 0, 4, 4, 3, 2, 1, 0]
    assert [x.tolist() for x in phrases._stretches(np.array([1], np.int32))] == [[0], [0]]
