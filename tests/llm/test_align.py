import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import align
from corpusloom.llm.queries import QUERIES


class Plain:
    """Both tokenizers over whole texts, and links told byte by byte."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(align.default_tokenizer())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=align.default_pieces())
        points = [*range(33, 127), *range(161, 173), *range(174, 256)]
        more = [b for b in range(256) if b not in points]
        self.letters = {chr(b): b for b in points} | {chr(256 + i): b for i, b in enumerate(more)}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False)
        b = self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a.ids]
        bytes_b = []
        for i in b:
            p = self.b.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
        want = (" " + text).encode()
        return (a.ids, bytes_a, b, bytes_b) if b"".join(bytes_a) == b"".join(bytes_b) == want else None

    def __call__(self, text):
        """(n_a, n_b, n_groups, n_links), the groups' hash and the links as a Counter."""
        found = self.tokens(text) if text else None
        if not found:
            return (0, 0, 0, 0), "", Counter()
        a, bytes_a, b, bytes_b = found
        groups, i, j = [], 0, 0
        while i < len(a):
            xs, ys, x, y = [a[i]], [b[j]], len(bytes_a[i]), len(bytes_b[j])
            i, j = i + 1, j + 1
            while x != y:
                if x < y:
                    xs, x, i = [*xs, a[i]], x + len(bytes_a[i]), i + 1
                else:
                    ys, y, j = [*ys, b[j]], y + len(bytes_b[j]), j + 1
            groups.append((xs, ys))
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        return (len(a), len(b), len(groups), sum(links.values())), hashlib.sha256(text.encode()).hexdigest(), links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def held(texts, plain):
    a = align.aligner(align.default_tokenizer(), align.default_pieces())
    numbers, hashes, n, code, times = a(texts)
    ends = np.cumsum(n)
    for k, t in enumerate(texts):
        want = plain(t)
        assert tuple(numbers[k].tolist()) == want[0] and hashes[k] == want[1], repr(t)
        part = slice(ends[k] - n[k], ends[k])
        assert dict(zip(map(tuple, zip(*(x.tolist() for x in np.divmod(code[part], len(a.size_b))), strict=True)), times[part].tolist(), strict=True)) == dict(want[2]), repr(t)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "  a", "one two", "one\n two", "one\n \ntwo", "one \n \n two", "x  y  z", "tab\tand \t x", "1 234  56",
    "it's we'll I'd", "<|endoftext|> a<|endoftext|>b", "<s> </s> <unk> <0x0A>", "▁ a", "a▁b ok", "é ß 📚 漢字 かな", "\x00a \x01", "ﬁ ﷺ ½ ²", "é é", "\x1c \x1d x", "   x    y", "a" * 3000,
]


def test_words_align_as_whole_texts_do(plain):
    held(ODD, plain)
    for t in ODD:
        held([t], plain)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n\t .,'1▁ 　漢<|>sZ"), max_size=30), min_size=1, max_size=6))
def test_random_texts(texts):
    held(texts, Plain() if not hasattr(test_random_texts, "plain") else test_random_texts.plain)


test_random_texts.plain = Plain()


def test_portions_cover_all_rows():
    assert list(align.portions(["aaa", None, "b" * 9, "", "c"], 4)) == [(0, 2), (2, 3), (3, 5)]
    assert list(align.portions([])) == []


def brute(rows, plain):
    told = [(d, *plain(t)) for d, t in rows]
    docs = Counter(p for *_, links in told for p in links)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        ((d, *n, sum(m for p, m in links.items() if docs[p] == best[p[0]]), sum(m * docs[p] for p, m in links.items()), h) for d, n, h, links in told), key=repr
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_report_equals_brute_force(spark, documents, odd_rows, plain):
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(ODD)), (3, "one\n \ntwo")]
    found = align.align_report(documents(rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == brute([r[:2] for r in rows], plain)
    assert align.align_report(documents([])).count() == 0


def test_query_equals_brute_force(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op11_alignment"](spark, sf_dir).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == brute(docs, plain)


def test_hot_pairs_without_broadcast(spark, documents, plain, monkeypatch):
    """Beyond the broadcast's bound the lookup is a shuffled join with the same result."""
    monkeypatch.setattr("corpusloom.llm.common.BROADCAST_ROWS", 3)
    rows = [(i, "the same hot words " + "x" * (i % 3)) for i in range(300)]
    found = align.align_report(documents(rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, plain)
