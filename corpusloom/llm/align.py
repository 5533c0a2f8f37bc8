"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet in the corpus.

A and B cut the same bytes; where both cut, a group ends, and every A token of a group is linked to every B token of it. Within
a task NumPy does this for many texts at once: running sums of token sizes are the ends, their intersection the common cuts, a
binary search in the cuts labels each token with its group, and repeats expand groups into links. Corpus-wide counts of pairs
come from a shuffle in two stages, salted by the task that saw the pair.

Both tokenizers break before a single space (checked when they are loaded), so a task aligns each distinct word of its texts once. Where white space meets white space, the parts around it stay together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, bounded_batches, few, with_row_ids, written
from corpusloom.llm.packing import PRETOKENS, _byte_letters, _ids, _merger, _PLAIN, _Pretokens, default_tokenizer

#: Characters of text that a worker aligns at once; a longer text alone.
PORTION = 1 << 20
#: Pretokens of the first tokenizer whose ids a worker remembers.
HELD = 1 << 17
#: Parts into which the first stage of the shuffle splits the counts of a pair.
SALTS = 16

#: A space before other white space or the end: there tokens depend on what lies on both sides.
_ODD = re.compile(r" (?:\s|\Z)")
#: Spaces with no other white space beside them, at which such a text can still be cut.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words whose tokens by the first tokenizer don't depend on other words.
_SIMPLE = re.compile("[\x21-\x7E\xA1-\xB1\xB4-\xB8\xBA\xBB\xBF-\u024F]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _piece_bytes(piece: str) -> bytes:
    """What a piece of the second tokenizer stands for."""
    byte = _BYTE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def expand(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, group of each A token, A index of each link, B index of each link) of two ascending sequences of token ends that
    finish at the same byte. Links come in the order of A, then B."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    per_b = np.bincount(group_b, minlength=len(cuts))
    first_b = np.cumsum(per_b) - per_b
    width = per_b[group_a]  # links of each A token
    left = np.repeat(np.arange(len(ends_a)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width - first_b[group_a], width)
    return cuts, group_a, left, right


class _Known(_Pretokens):
    """At most HELD pretokens."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= HELD:
            self.clear()
        return super().__missing__(word)


class Aligner:
    """Both tokenizers, with tables of what their tokens stand for."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        merge = _merger(path_a)
        self.pretokens = _Known(merge or (lambda word: self.a.encode(word.decode(), add_special_tokens=False).ids))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        sizes = {i: len(token) if all(c in letters for c in token) else 1 for token, i in self.a.get_vocab().items()}
        self.size_a = np.array([sizes.get(i, 1) for i in range(max(sizes) + 1)], np.int64)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [_piece_bytes(p) for p in pieces]
        self.size_b = np.array([len(p) for p in self.bytes_b], np.int64)
        self.codes = len(self.size_a) * len(self.size_b)
        #: The first is a byte-level BPE of the known pattern, and no piece of the second goes on over a space.
        self.by_words = merge is not None and not any("▁" in p.lstrip("▁") for p in pieces)
        #: How a token reads in the text of groups: A inside a group and at its A tokens' end, then B likewise.
        self.written = [f"{i}{end}" for n, ends in ((len(self.size_a), ",|"), (len(pieces), ",;")) for end in ends for i in range(n)]
        self.width = np.array(list(map(len, self.written)), np.int64)

    def words(self, text: str) -> list[str]:
        """A text's parts whose tokens don't depend on each other, each to be read with a space before it."""
        if not self.by_words:
            return [text]
        return _CUT.split(text) if text.startswith(" ") or _ODD.search(text) else text.split(" ")

    def _tokens_a(self, words: list[str], simple: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many are each word's. The first `simple` ones are plain and without
        white space, so they are cut in one go: each has one pretoken that starts with a space."""
        found = PRETOKENS.findall(" " + " ".join(words[:simple])) if simple else []
        ids = list(map(self.pretokens.__getitem__, found))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = [k for k, p in enumerate(found) if p[0] == " "]
        for w in words[simple:]:
            if _PLAIN.fullmatch(w):
                ids.append(b"".join(map(self.pretokens.__getitem__, PRETOKENS.findall(f" {w}"))))
            else:
                ids.append(_ids(self.a.encode(f" {w}", add_special_tokens=False).ids))
        rest = np.array([len(r) // 4 for r in ids[len(found) :]], np.int64)
        return np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.concatenate((np.add.reduceat(size, starts) if starts else size, rest))

    def _given_back(self, words: list[str], ids_b: list[list[int]], size_b: np.ndarray) -> np.ndarray:
        """Whether each word's pieces, of `size_b` bytes in all, spell a space and the word."""
        spelt = [f" {w}".encode() for w in words]
        if b"".join(spelt) == b"".join(map(self.bytes_b.__getitem__, chain.from_iterable(ids_b))):
            return size_b == np.fromiter(map(len, spelt), np.int64, len(spelt))
        return np.array([x == b"".join(map(self.bytes_b.__getitem__, ids)) for x, ids in zip(spelt, ids_b, strict=True)])

    def _aligned(self, words: list[str], simple: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The alignment of distinct words: whether bytes are given back, the numbers of tokens, groups and links, the groups as
        text, and the distinct links: how many a word has, and one after the other their codes and how often each occurs."""
        ids_b = self.b.encode(words, num_threads=1)
        a, n_a = self._tokens_a(words, simple)
        n_b = np.fromiter(map(len, ids_b), np.int64, len(words))
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
        of_a, of_b = np.repeat(np.arange(len(words)), n_a), np.repeat(np.arange(len(words)), n_b)
        good = self._given_back(words, ids_b, np.bincount(of_b, self.size_b[b], len(words)))
        if not good.all():
            a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
        cuts, group_a, left, right = expand(np.cumsum(self.size_a[a]), ends_b := np.cumsum(self.size_b[b]))
        group_b = np.searchsorted(cuts, ends_b)
        of_group = of_b[np.searchsorted(group_b, np.arange(len(cuts)))]
        numbers = np.stack([np.bincount(of, minlength=len(words)) for of in (of_a, of_b, of_group, of_a[left])], 1)
        codes, times = _distinct(of_a[left] * self.codes + a[left] * len(self.size_b) + b[right])
        word, code = np.divmod(codes, self.codes)
        # Groups as text: each group's A tokens, then its B tokens, from a table that has them with what follows.
        last_a, last_b = np.append(np.diff(group_a), 1)[: len(a)] > 0, np.append(np.diff(group_b), 1)[: len(b)] > 0
        at = np.concatenate((a + last_a * len(self.size_a), 2 * len(self.size_a) + b + last_b * len(self.size_b)))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        text = "".join(map(self.written.__getitem__, at[order].tolist()))
        stop = np.cumsum(np.bincount(np.concatenate((of_a, of_b)), self.width[at], len(words)).astype(np.int64)).tolist()
        texts = [text[i : j - 1] for i, j in zip([0, *stop], stop, strict=False)]
        return good, numbers, texts, np.bincount(word, minlength=len(words)), code, times

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the numbers of tokens, groups and links and the groups' hash; and all texts' distinct links: how many
        each text has, and one after the other their codes and how often each occurs in the text."""
        words = [self.words(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        if not flat:
            return np.zeros((len(texts), 4), np.int64), [""] * len(texts), *(np.zeros(n, np.int64) for n in (len(texts), 0, 0))
        seen = dict.fromkeys(flat)
        simple = [w for w, plain in zip(seen, map(_SIMPLE.fullmatch, seen), strict=True) if plain]
        types = simple + [w for w in seen if not _SIMPLE.fullmatch(w)] if len(simple) < len(seen) else simple
        good, facts, groups, n_links, codes, times = self._aligned(types, len(simple))
        place = dict(zip(types, range(len(types)), strict=True))
        ids = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        per_doc = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(words)), per_doc)
        whole = per_doc > 0
        whole[doc[~good[ids]]] = False
        numbers = np.stack([np.bincount(doc, facts[ids, x], len(words)) for x in range(4)], 1).astype(np.int64) * whole[:, None]
        parts = list(map(groups.__getitem__, ids.tolist()))
        ends = np.cumsum(per_doc).tolist()
        hashes = [hashlib.sha256(";".join(parts[e - k : e]).encode()).hexdigest() if ok else "" for e, k, ok in zip(ends, per_doc.tolist(), whole.tolist(), strict=True)]
        of, member, count = self._members(doc[whole[doc]], ids[whole[doc]], len(types))
        width = n_links[member]
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - (np.cumsum(n_links) - n_links)[member], width)
        found, total = _distinct(np.repeat(of, width) * self.codes + codes[at], np.repeat(count, width) * times[at])
        of, code = np.divmod(found, self.codes)
        return numbers, hashes, np.bincount(of, minlength=len(words)), code, total

    @staticmethod
    def _members(doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, occurrences) of the distinct words of each text."""
        pairs, count = _distinct(doc * n + word)
        return *np.divmod(pairs, n), count


def _distinct(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs or what its weights add up to."""
    if not len(keys):
        return keys, keys
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if weight is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weight[order], first)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def portions(texts: list[str | None], most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most that many characters, or of one row."""
    start = total = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


_FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def alignments(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, text: str = "text", doc_id: str = "doc_id", row: str = f"{OWN}row") -> DataFrame:
    """The alignment of every text, read with a space before it: its row number, doc_id, numbers of tokens, groups and link
    occurrences, the hash of its groups, and its distinct links as arrays `a`, `b` (ids) and `m` (occurrences), sorted.

    Texts that are null or empty, or that either tokenizer doesn't give back byte by byte, have no tokens: zeros, an empty
    hash and empty arrays. Each row is a text of its own, with equal, repeated or null ids too; an empty table gives no rows.
    Other columns are ignored.
    """
    path_a, path_b = tokenizer or default_tokenizer(), pieces or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, stop in portions(texts):
                numbers, hashes, n, code, times = align(texts[start:stop])
                a, b = np.divmod(code, len(align.size_b))
                at = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (a, b, times)]
                facts = [pa.array(numbers[:, x]) for x in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], batch.column(1)[start:stop], *facts, pa.array(hashes), *lists],
                    [row, "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "m"],
                )

    numbered = with_row_ids(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), row)
    return numbered.select(row, "doc_id", "text").mapInArrow(run, f"{row} long, doc_id long, {_FACTS}, a array<int>, b array<int>, m array<int>")


def _links(aligned: DataFrame, *more: str) -> DataFrame:
    return aligned.select(*more, F.inline(F.arrays_zip("a", "b", "m")))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, best) of every linked pair of ids: in how many rows of alignments() it is linked, and whether no other
    pair of its A id is in more. The first stage adds up by pair and salt, so that no pair's partial counts meet in one task."""
    salt = f"{OWN}salt"
    first = _links(aligned).withColumn(salt, F.spark_partition_id() % SALTS).groupBy("a", "b", salt).agg(F.count("*").alias("n"))
    counts = first.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy("a"))  # as many rows as B has tokens at most
    return counts.withColumn("best", F.col("n_docs") == most)


def align_report(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; nulls, empty texts, repeated rows
    and empty tables as in alignments(). n_best: link occurrences whose pair is the A id's most frequent, ties included;
    count_sum: the pairs' counts over link occurrences."""
    row = f"{OWN}row"
    bounded_batches(docs.sparkSession)
    aligned = written(alignments(docs, tokenizer, pieces), "alignments")
    counts = written(pair_counts(aligned), "pair-counts")
    told = _links(aligned, row).join(few(counts), ["a", "b"])
    sums = told.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.join(sums, row, "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
