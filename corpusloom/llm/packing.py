"""Packing documents into sequences: best fit, then swap-based local search.

Texts become token ids and pieces once; what is shuffled is a row of numbers per piece. Pieces are dealt out evenly into
groups of a bounded size, and each group is packed on its own: best fit decreasing, then documents move or are exchanged
one-for-one and two-for-one between underfull bins so that squared fill rises, until a bin is empty or no step helps. A
group's waste is under a sequence once its bins reach the lower bound, so more groups cost one sequence each at most.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

CAPACITY = 2048
END_ID = 0
#: Pieces in a group that is packed on its own, on average.
GROUP_PIECES = 16_384
#: Steps of a group's search at most, bins in a row that it fails to empty, and pairs of a bin's documents that one step tries.
MAX_STEPS = 2000
STUCK = 64
PAIRS = 64
#: The pre-tokenizer's pattern, fixed by the vocabulary, as it reads for plain texts.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on whose classes all libraries agree, so without fractions and raised digits; a text with others goes to the
#: tokenizer whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7E\xA1-\xB1\xB4-\xB8\xBA\xBB\xBF-\u024F]*")
_CACHE = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes bytes as: visible ones stand for themselves, the others for the
    code points from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _merger(path: str) -> Callable[[bytes], list[int]] | None:
    """A quicker way to the same ids for one pretoken, by ranks; None where a vocabulary's ids aren't in the order of its
    merges, for then ranks don't decide."""
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    vocabulary, merges = found["model"]["vocab"], found["model"]["merges"]
    added = {t["content"] for t in found["added_tokens"]}
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    if any(vocabulary.get(m) != 256 + k for k, m in enumerate(joined)):
        return None
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in added}
    core = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return getattr(core, "encode_single_piece", None)


class _Pretokens(dict):
    """Pretoken to its ids as little-endian bytes; forgets everything when full."""

    def __init__(self, merge: Callable[[bytes], list[int]]) -> None:
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = self[word] = _ids(self.merge(word.encode()))
        return ids


def _ids(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Encoder:
    """Token ids as bytes. A byte-level BPE works on each pretoken alone, so those of plain texts are looked up."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Pretokens(_merger(path) or (lambda word: self.tokenizer.encode(word.decode(), add_special_tokens=False).ids))

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.known.__getitem__, PRETOKENS.findall(text)))
        return _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of `capacity`, with the remainder, if any, first."""
    head = length % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, length, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row; an empty or null text is the end id alone."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = memoryview((ids(body) if body else b"") + end)
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    for x, v in zip(out, (one, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        x.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        encoded, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best fit decreasing: indices by bin."""
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s: some bin has the space s
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = open_spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        if left := space - n:
            by_space[left].append(b)
            open_spaces |= 1 << left
    return bins


def least_bins(lengths: list[int], capacity: int = CAPACITY) -> int:
    """A lower bound: the tokens that there are, and for each length t up to half a bin the pieces over capacity - t, which
    share no bin with a piece of t or more, those over half, and the room that the rest of t or more needs beside them."""
    size = np.sort(np.array(lengths, np.int64))
    total = np.concatenate(([0], np.cumsum(size)))
    at = lambda n: np.searchsorted(size, n, "right")  # noqa: E731  pieces of n tokens at most
    t = np.unique(size[size * 2 <= capacity])
    alone, half = at(capacity - t), at(capacity // 2)
    middle = (alone - half) * capacity - (total[alone] - total[half])  # room beside the pieces over half that aren't alone
    rest = total[half] - total[np.searchsorted(size, t, "left")]
    bound = len(size) - half + np.maximum(0, -(-(rest - middle) // capacity))
    return int(max(-(-total[-1] // capacity), len(size) - half, bound.max(initial=0)))


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, steps: int = MAX_STEPS) -> list[list[int]]:
    """Empties bins by steps that raise squared fill.

    The least filled bin gives its documents away: a document moves to where it fits best, or is exchanged for a shorter
    one, or two are exchanged for one shorter than both together, each time filling the other bin further. Every step takes
    tokens out of the bin, so it ends; a bin that can't be emptied stays as it is left. Ends at the lower bound, after
    `steps` steps, or after STUCK bins in a row that couldn't be emptied.
    """
    size = np.array(lengths, np.int64)
    fill = np.array([size[b].sum() for b in bins], np.int64)
    where = np.empty(len(size), np.int64)
    for b, members in enumerate(bins):
        where[members] = b
    least = least_bins(lengths, capacity) if lengths else 0
    count, stuck = len(bins), set()
    while count > least and steps > 0 and len(stuck) < STUCK:
        left = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in stuck]
        if not left:
            break
        giver = min(left, key=lambda b: (fill[b], b))
        others = np.flatnonzero((fill > 0) & (fill < capacity))
        others = others[others != giver]
        if (capacity - fill[others]).sum() < fill[giver]:
            break  # no room for any bin's documents: the others hold at least as much
        while bins[giver] and steps > 0 and _step(bins, size, fill, giver, others, capacity, where):
            steps -= 1
        if bins[giver]:
            stuck.add(giver)
            steps -= 1
        else:
            count -= 1
            stuck.clear()
    return [b for b in bins if b]


def _step(
    bins: list[list[int]], size: np.ndarray, fill: np.ndarray, giver: int, others: np.ndarray, capacity: int, where: np.ndarray | None = None
) -> bool:
    """One move or exchange out of `giver`, the one that fills another bin most; False where there is none. `others` are
    bins in ascending order, `where` the bin of each document. Documents of one length count as one, and of pairs the PAIRS
    longest are tried."""
    space = capacity - fill[others]
    if not len(others):
        return False
    if where is None:
        where = np.full(len(size), -1)
        for b in (giver, *others.tolist()):
            where[bins[b]] = b
    place = np.full(len(bins), -1)
    place[others] = np.arange(len(others))
    home = np.where(where >= 0, place[where], -1)
    docs = np.flatnonzero((home >= 0) & (space[home] > 0))
    home, lengths = home[docs], size[docs]
    mine = sorted({int(size[i]): i for i in bins[giver]}.values(), key=lambda i: (-size[i], i))
    best: tuple | None = None  # gain in squared fill, documents that go, document that comes, other bin

    def keep(gone: tuple[int, ...], comes: int | None, to: int, net: int) -> None:
        nonlocal best
        gain = 2 * net * (int(fill[to]) - int(fill[giver]) + net)
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, gone, comes, to, net)

    def offer(gone: tuple[int, ...], tokens: int) -> None:
        fits = np.flatnonzero(space >= tokens)
        if len(gone) == 1 and len(fits):
            keep(gone, None, int(others[fits[np.argmin(space[fits])]]), tokens)
        net = tokens - lengths
        can = np.flatnonzero((net > 0) & (net <= space[home]))
        if len(can):
            k = can[np.argmax((fill[others[home[can]]] - fill[giver] + net[can]) * net[can])]
            keep(gone, int(docs[k]), int(others[home[k]]), int(net[k]))

    for i in mine:
        offer((i,), int(size[i]))
    if best is None:
        longest = sorted(bins[giver], key=lambda i: (-size[i], i))
        pairs = {(int(size[i]), int(size[j])): (i, j) for i, j in islice(combinations(longest, 2), 16 * PAIRS)}
        for i, j in islice(pairs.values(), PAIRS):
            offer((i, j), int(size[i] + size[j]))
    if best is None:
        return False
    _, gone, comes, to, net = best
    for i in gone:
        bins[giver].remove(i)
        bins[to].append(i)
        where[i] = to
    if comes is not None:
        bins[to].remove(comes)
        bins[giver].append(comes)
        where[comes] = giver
    fill[to] += net
    fill[giver] -= net
    return True


def pack(found: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(). A group is one partition, so it is bounded by its share."""
    found = written(found, "pieces")
    groups = max(1, -(-found.count() // group_pieces))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")])
        lengths = rows["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = TaskContext.get().partitionId() << 32
        for b, members in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + b, at
                at += lengths[i]
        yield from rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).combine_chunks().to_batches(50_000)

    return found.repartition(groups).mapInArrow(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Packs every row of `docs`: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Null and empty texts are one piece of the end id. Repeated rows are packed as often as they occur. No piece is dropped
    and none is cut but documents longer than a sequence. An empty table gives an empty table; other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, text, doc_id))
