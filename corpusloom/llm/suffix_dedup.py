"""Removal of long repeats by a logarithmic family of sparse suffix arrays.

A byte goes if a string of MATCH bytes that covers it also starts earlier: in a document with a smaller id, or earlier in its
own. Each string belongs to a sample: the leftmost of its grams of GRAM bytes whose hash is smallest. That depends on the
string's own bytes alone, so equal strings belong to equal grams at equal places within them, and neighbouring strings mostly
share a sample. A sample's context is the bytes that all strings of its own cover.

Only contexts whose gram occurs twice can hold a repeat. A first pass over the texts finds those: hashes of grams, one a batch
of texts, meet in parts dealt out by hash. A second pass sends their contexts, as bytes, to parts dealt out by gram. Each part
keeps the index family: a batch of contexts is sorted by its bytes into a suffix array of its own, merge-scanned against the
arrays of the levels, and arrays of about equal size are merged into the next level. A context that is found whole earlier is
settled: all its strings repeat. What is left of a gram with several contexts lies at the edges of repeats. There two suffix
arrays are made, of what follows the gram and, read backwards, of what precedes it, with the lengths to which neighbours match;
two strings are equal where both lengths reach as far as the string does.

Hashes choose which strings are looked at and where they meet; equality is told by bytes alone. Contexts that repeat within a
batch are settled before anything is shuffled, so a passage that a third of all documents share sends as many contexts as there
are batches, not documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, partitions, with_row_ids, written

MATCH = 100
#: Longer grams are sampled more densely, but fewer are shared by chance and each edge has fewer strings.
GRAM = 56
REACH = MATCH - GRAM
#: Bytes of text that are hashed at a time; longer documents are read in pieces that overlap.
CHUNK = 1 << 19
#: Bytes of text whose samples are reduced together before they are shuffled.
REDUCED = 8 << 20
WINDOW = 8
#: Bytes of the longest context, and its width as a key: before and size of it stand at the end, so no key ends in a zero.
WIDTH = MATCH + REACH
KEY = WIDTH + 8
#: Contexts that are sent, and sorted into an array of the family, at a time.
SENT = 1 << 16
SORTED = 1 << 15
#: Bytes of text a part of the index answers for, at most but for uneven grams.
PART_BYTES = 128 << 20
#: Room for places in a chunk beside the upper bits of hashes.
_PLACES = (1 << 22) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LAST = np.iinfo(np.int64).max
_U = np.uint64


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(n, _U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * _U(pow(base, k, 1 << 64))
        k += m
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


class Rolling:
    """Hashes of byte ranges of an array, WINDOW bytes at least, from prefix sums of mixed windows times powers of an odd base.

    A window is the WINDOW bytes from a place on. Sums of plain bytes modulo 2^64 would have strings that collide for every
    base (Thue-Morse's); mixed windows have no such form."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        base = _BASES[which]
        n = 1 << max(CHUNK.bit_length(), len(data).bit_length())  # one size for nearly all, so tables are made once
        self.sums = np.zeros(len(data) + 1, _U)
        wide = np.concatenate((data, np.zeros(WINDOW - 1, np.uint8)))
        windows = np.ndarray(len(data), "<u8", wide.data, strides=(1,)) if len(data) else np.zeros(0, _U)
        mixed = _mixed(windows ^ _U(base))
        mixed *= _powers(base, n)[: len(data)]
        np.cumsum(mixed, out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), n)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end - WINDOW + 1] - self.sums[start]) * self.back[start])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mixed((self.sums[width - WINDOW + 1 :][:n] - self.sums[:n]) * self.back[:n])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every `width` neighbours."""
    w = 1
    while 2 * w <= width:
        x = best(x[:-w], x[w:])
        w *= 2
    return best(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


class Chunk:
    """Texts, or pieces of a long one, laid end to end. Of each: its row, the place of its first byte in the document, and
    the range of string starts that it answers for."""

    def __init__(self, pieces: list[tuple[int, int, bytes, int, int, int]]) -> None:
        self.data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        self.row, self.offset = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
        size = np.array([len(p[2]) for p in pieces], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.first, self.last, self.length = (np.array([p[i] for p in pieces], np.int64) for i in (3, 4, 5))

    def of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, place, "right") - 1


def _chunks(texts: list[bytes]) -> Iterator[Chunk]:
    """Texts too short for a string of MATCH bytes have no part in any chunk."""
    held, size = [], 0
    for row, text in enumerate(texts):
        n = len(text)
        for at in range(0, max(0, n - MATCH + 1), CHUNK):
            to = min(at + CHUNK, n - MATCH + 1)
            left, right = max(0, at - REACH), min(n, to + MATCH + REACH)
            if size + right - left > CHUNK and held:
                yield Chunk(held)
                held, size = [], 0
            held.append((row, left, text if (left, right) == (0, n) else text[left:right], at - left, to - left, n))
            size += right - left
    if held:
        yield Chunk(held)


def _samples(chunk: Chunk) -> dict[str, np.ndarray]:
    """Samples of a chunk: row, pos where the first of its strings starts, size (how many strings, one byte apart, belong to
    it), before (bytes from pos to its gram), and hashes of the gram and of the context."""
    one = Rolling(chunk.data, 0)
    h = one.grams(GRAM)
    least = _sliding((h & ~_U(_PLACES)) | np.arange(len(h), dtype=_U), REACH + 1, np.minimum)
    ok = np.zeros(len(least) + 1, np.int8)
    ok[chunk.start + chunk.first] += 1
    np.subtract.at(ok, chunk.start + chunk.last, 1)
    start = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
    owner = (least[start] & _U(_PLACES)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    size = np.diff(np.append(new, len(start)))
    at, gram = start[new], owner[new]
    before = gram - at
    key = _mixed(one.ranges(at, at + size + MATCH - 1) + (before * 64 + size).astype(_U) * _U(_BASES[1]))
    piece = chunk.of(at)
    pos = at - chunk.start[piece] + chunk.offset[piece]
    return {"row": chunk.row[piece], "pos": pos, "before": before, "size": size, "gram": h[gram], "key": key}


class Bytes:
    """Texts end to end, with room behind them, to take contexts from."""

    def __init__(self, texts: list[bytes]) -> None:
        self.base = np.cumsum([0, *map(len, texts)])
        self.data = np.frombuffer(b"".join([*texts, bytes(WIDTH)]), np.uint8)
        self.windows = np.lib.stride_tricks.sliding_window_view(self.data, WIDTH)
        self.words = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))

    def contexts(self, x: dict[str, np.ndarray]) -> np.ndarray:
        found = self.windows[self.base[x["row"]] + x["pos"]]
        found[np.arange(WIDTH) >= (x["size"] + MATCH - 1)[:, None]] = 0
        return found

    def equal(self, x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
        """Whether contexts x[i] and y[i] have the same bytes and the same gram in them."""
        out = (x["size"] == y["size"]) & (x["before"] == y["before"])
        for at in range(0, len(out), SENT):
            cut = np.arange(at, min(at + SENT, len(out)))
            out[cut] &= (self.contexts(_taken(x, cut)) == self.contexts(_taken(y, cut))).all(axis=1)
        return out

    def spread(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """A hash of each context's gram."""
        at = self.base[x["row"]] + x["pos"] + x["before"]
        h = np.zeros(len(at), _U)
        for k in range(0, GRAM, 8):
            h = _mixed(h * _U(_BASES[0]) + self.words[at + k])
        return h


class LevelFamily:
    """The logarithmic index family: sorted arrays whose sizes grow geometrically, one entry per distinct key.

    add() sorts a batch by key, merge-scans it against every level and returns the entries that repeat an earlier one; of
    equal keys the earliest by (doc, row, pos) stays in the index, whichever batch it came in.
    """

    def __init__(self) -> None:
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, batch: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        batch = _taken(batch, np.lexsort((batch["pos"], batch["row"], batch["doc"])))
        batch = _taken(batch, np.argsort(batch["key"], kind="stable"))
        again = np.concatenate(([False], batch["key"][1:] == batch["key"][:-1]))
        gone, batch = [_taken(batch, again)], _taken(batch, ~again)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["key"], batch["key"]), len(level["key"]) - 1)
            found = np.flatnonzero(level["key"][at] == batch["key"])
            if not len(found):
                continue
            old, new = _taken(level, at[found]), _taken(batch, found)
            later = _before(old, new)
            gone += [_taken(new, later), _taken(old, ~later)]
            for name, column in level.items():
                column[at[found[~later]]] = new[name][~later]
            stays = np.ones(len(batch["key"]), bool)
            stays[found] = False
            batch = _taken(batch, stays)
        if len(batch["key"]):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]["key"]) < 2 * len(self.levels[-1]["key"]):
            self.merge()
        return _joined(gone)

    def merge(self) -> None:
        both = _joined([self.levels.pop(-2), self.levels.pop()])
        self.levels.append(_taken(both, np.argsort(both["key"], kind="stable")))

    def all(self) -> dict[str, np.ndarray] | None:
        while len(self.levels) > 1:
            self.merge()
        return self.levels[0] if self.levels else None


def _taken(x: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in x.items()}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _before(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Whether entry a[i] starts earlier than b[i]."""
    same_doc, same_row = a["doc"] == b["doc"], a["row"] == b["row"]
    return (a["doc"] < b["doc"]) | (same_doc & (a["row"] < b["row"])) | (same_doc & same_row & (a["pos"] < b["pos"]))


def _leads(*keys: np.ndarray) -> np.ndarray:
    """For entries in order of their start: the first one equal in all keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    heads = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    lead = np.empty(len(order), np.int64)
    lead[order] = heads
    return lead


# Rows that tasks exchange: part names the task that gets a row, kind what it holds, body the columns.
_EXCHANGE = "part int, kind int, body binary"
_GRAM, _SPAN, _EDGE, _CONTEXT = 0, 1, 2, 3
_COLUMNS = {
    _GRAM: (("row", "i8"), ("pos", "i8"), ("before", "u1"), ("size", "u1"), ("gram", "u5")),
    _SPAN: (("row", "i8"), ("a", "i8"), ("b", "i8")),
    _EDGE: (("row", "i8"), ("a", "i8"), ("b", "i8")),
    _CONTEXT: (("doc", "i8"), ("row", "i8"), ("pos", "i8"), ("before", "u1"), ("size", "u1"), ("context", "bytes")),
}


def _encoded(kind: int, x: dict[str, np.ndarray]) -> bytes:
    """Columns one after another, compressed; ids and places as differences, so that neighbours' zeros count little, and five
    bytes of the gram's hash beside those that choose its part."""
    n = len(x["row"])
    out = []
    for name, kind_of in _COLUMNS[kind]:
        v = x[name]
        if kind_of == "i8":
            v = np.ascontiguousarray(v).astype("<i8", copy=False)
            v = np.diff(v, prepend=v.dtype.type(0))
            out.append(np.ascontiguousarray(v.view(np.uint8).reshape(n, 8).T).tobytes())
        elif kind_of == "u5":
            out.append(np.ascontiguousarray(v).view(np.uint8).reshape(n, 8)[:, :5].tobytes())
        else:
            out.append((v if kind_of == "bytes" else v.astype(f"<{kind_of}")).tobytes())
    plain = b"".join(out)
    return n.to_bytes(8, "little") + len(plain).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(plain, asbytes=True)


def _decoded(kind: int, body: bytes) -> dict[str, np.ndarray]:
    n, at, out = int.from_bytes(body[:8], "little"), 0, {}
    body = pa.Codec("zstd").decompress(body[16:], int.from_bytes(body[8:16], "little"), asbytes=True)
    for name, kind_of in _COLUMNS[kind]:
        width = WIDTH if kind_of == "bytes" else int(kind_of[1])
        raw = np.frombuffer(body, np.uint8, n * width, at)
        at += n * width
        if kind_of == "i8":
            out[name] = np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").reshape(n))
        elif kind_of == "u5":
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = raw.reshape(n, width)
            out[name] = wide.view("<u8").reshape(n)
        elif kind_of == "bytes":
            out[name] = raw.reshape(n, width)
        else:
            out[name] = raw.view(f"<{kind_of}").copy()
    return out


def _runs(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Spans [a, b) by row, with those that touch or overlap joined."""
    if not len(row):
        return {"row": row, "a": a, "b": b}
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    # Ends are carried on within a row only: rows are set apart by more than any end.
    rank = np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))
    far = np.int64(max(int(b.max()), int(a.max())) + 2)
    reach = np.maximum.accumulate(b + rank * far) - rank * far
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (a[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    return {"row": row[at], "a": a[at], "b": np.maximum.reduceat(b, at)}


def _sent(parts: int, kind: int, entries: dict[str, np.ndarray], spread: np.ndarray, rest: list[tuple[int, dict[str, np.ndarray]]], salt: int) -> pa.RecordBatch:
    """Exchange rows: entries dealt out by `spread`, everything else, which only passes through, by a running number."""
    part = (spread % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(k, kind, _encoded(kind, _taken(entries, order[a:b]))) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b]
    for other, x in rest:
        for at in range(0, len(x["row"]), 50_000):
            salt += 1
            rows.append((salt % parts, other, _encoded(other, _taken(x, np.arange(at, min(at + 50_000, len(x["row"])))))))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "body"])


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts pass REDUCED bytes, to bound what one step holds."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + REDUCED, "right")))
            yield batch.slice(at, to - at)
            at = to


def _shape(x: dict[str, np.ndarray]) -> np.ndarray:
    return x["before"].astype(np.int64) << 8 | x["size"]


def _index_grams(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in _portions(batches):
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy()
            rows = batch.column("row").to_numpy()
            order = np.lexsort((rows, ids))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            texts = [texts[i] or b"" for i in order]
            rows = rows[order]
            found = [_samples(c) for c in _chunks(texts)]
            if not found:
                continue
            x = _joined(found)  # in order of rows and places, as texts are
            own = np.arange(len(x["row"]))
            lead, head = _leads(x["gram"], x["key"]), _leads(x["gram"])
            settled = lead != own
            at = np.flatnonzero(settled)
            settled[at] = Bytes(texts).equal(_taken(x, at), _taken(x, lead[at]))
            # Grams with several contexts in this batch are at an edge; of the others the first goes to meet other batches.
            several = np.zeros(len(own), bool)
            several[head[~settled & (head != own)]] = True
            edge = ~settled & several[head]
            x |= {"row": rows[x["row"]], "a": x["pos"], "b": x["pos"] + x["size"] + MATCH - 1}
            spans = _runs(x["row"][settled], x["a"][settled], x["b"][settled])
            edges = _taken(x, edge)
            first = _taken(x, head == own)
            first["gram"] = _mixed(first["gram"])  # the smallest of many has zeros in front
            yield _sent(parts, _GRAM, first, first["gram"] >> _U(40), [(_SPAN, spans), (_EDGE, edges | {"b": _shape(edges)})], salt)
            salt += 1 + len(batch)

    return run


def _found(kind: int, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(row), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(row[cut]), kind, np.int32)), pa.array(row[cut]), pa.array(a[cut]), pa.array(b[cut])], ["kind", "row", "a", "b"]
        )


def _settle_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they are, and samples (row, a, shape) whose gram occurs more than once."""
    held = []
    for batch in batches:
        for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body"), strict=True):
            x = _decoded(kind, body.as_py())
            if kind == _GRAM:
                held.append(x)
            else:
                yield from _found(kind, x["row"], x["a"], x["b"])
    if held:
        x = _joined(held)
        held.clear()
        order = np.argsort(x["gram"])
        same = np.concatenate(([False], x["gram"][order[1:]] == x["gram"][order[:-1]], [False]))
        x = _taken(x, np.sort(order[same[1:] | same[:-1]]))
        yield from _found(_EDGE, x["row"], x["pos"], _shape(x))


def _index_contexts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            places = batch.column("places")
            count, place = places.value_lengths().to_numpy(), places.flatten().to_numpy()
            texts = Bytes([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            ids, rows = batch.column("doc_id").fill_null(_LAST).to_numpy(), batch.column("row").to_numpy()
            x = {"row": np.repeat(np.arange(len(count)), count), "pos": place >> 16, "before": place >> 8 & 255, "size": place & 255}
            for at in range(0, len(place), SENT):
                y = _taken(x, np.arange(at, min(at + SENT, len(place))))
                spread, context = texts.spread(y), texts.contexts(y)
                yield _sent(parts, _CONTEXT, y | {"doc": ids[y["row"]], "row": rows[y["row"]], "context": context}, spread >> _U(20), [], 0)

    return run


def _keyed(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Contexts with their bytes as sortable keys."""
    key = np.zeros((len(x["row"]), KEY), np.uint8)
    key[:, :WIDTH], key[:, KEY - 2], key[:, KEY - 1] = x["context"], x["before"], x["size"]
    return {"key": key.view(f"S{KEY}")[:, 0], "doc": x["doc"], "row": x["row"], "pos": x["pos"]}


def _shape_of(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, before, size) of keys."""
    raw = np.ascontiguousarray(x["key"]).view(np.uint8).reshape(-1, KEY)
    return raw, raw[:, KEY - 2].astype(np.int64), raw[:, KEY - 1].astype(np.int64)


def _settle_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family, held, n = LevelFamily(), [], 0

    def settle() -> Iterator[pa.RecordBatch]:
        gone = family.add(_keyed(_joined(held)))
        held.clear()
        yield from _found(_SPAN, gone["row"], gone["pos"], gone["pos"] + _shape_of(gone)[2] + MATCH - 1)

    for batch in batches:
        for body in batch.column("body"):
            held.append(_decoded(_CONTEXT, body.as_py()))
            n += len(held[-1]["row"])
            if n >= SORTED:
                n = 0
                yield from settle()
    if held:
        yield from settle()
    left = family.all()
    if left is not None:
        family.levels.clear()
        spans = _edge_strings(left)
        yield from _found(_SPAN, spans["row"], spans["a"], spans["b"])


def _columns(raw: np.ndarray, first: np.ndarray, step: int, width: int) -> np.ndarray:
    """Of each row of bytes, `width` of them from place `first` on, forwards or backwards; zero outside a context. A last
    column of ones keeps zeros at the end in keys."""
    out = np.ones((len(raw), width + 1), np.uint8)
    for k in range(width):
        at = first + step * k
        out[:, k] = np.where((at >= 0) & (at < WIDTH), raw[np.arange(len(raw)), np.clip(at, 0, WIDTH - 1)], 0)
    return out


def _matches(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array: the order of `side` within groups, and the bytes that each shares with the one before it, -1 for the
    first of a group."""
    order = np.argsort(side.view(f"S{side.shape[1]}")[:, 0], kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    common = np.full(len(order), -1)
    differ = side[order[1:]] != side[order[:-1]]
    differ[:, -1] = True
    same = group[order[1:]] == group[order[:-1]]
    common[1:][same] = differ[same].argmax(axis=1)
    return order, common


def _edge_strings(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans of strings that repeat an earlier one, among distinct contexts."""
    raw, before, _ = _shape_of(x)
    grams = _columns(raw, before, 1, GRAM).view(f"S{GRAM + 1}")[:, 0]
    order = np.argsort(grams, kind="stable")
    new = np.concatenate(([True], grams[order[1:]] != grams[order[:-1]]))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    several = np.bincount(group)[group] > 1
    x, group = _taken(x, several), group[several]
    _, before, _ = _shape_of(x)
    order = np.lexsort((x["pos"] + before, x["row"], x["doc"]))
    x, group = _taken(x, order), group[order]
    raw, before, size = _shape_of(x)
    n = len(group)
    left, left_common = _matches(group, _columns(raw, before - 1, -1, REACH))
    right, right_common = _matches(group, _columns(raw, before + GRAM, 1, REACH))
    rows, starts = [], []
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for ahead in range(REACH + 1):  # strings that start this many bytes before the gram
        left_class[left] = np.cumsum(left_common < ahead)
        right_class[right] = np.cumsum(right_common < REACH - ahead)
        have = np.flatnonzero((ahead <= before) & (before - ahead < size))
        key = left_class[have] * (n + 1) + right_class[have]
        order = np.argsort(key, kind="stable")
        gone = have[order[1:][key[order[1:]] == key[order[:-1]]]]
        rows.append(x["row"][gone])
        starts.append(x["pos"][gone] + before[gone] - ahead)
    row, start = np.concatenate(rows), np.concatenate(starts)
    return _runs(row, start, start + MATCH)


def _met(rows: DataFrame, found: DataFrame, all_rows: bool) -> DataFrame:
    """`rows` with what is found of them by row number, with the others too if `all_rows`. Texts of the others aren't shuffled
    as long as the numbers of the rows to join are few enough to broadcast."""
    numbers = found.select("row").distinct()
    if numbers.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows.join(found, "row", "left" if all_rows else "inner")
    numbers = F.broadcast(numbers)
    some = rows.join(numbers, "row", "left_semi").join(found, "row", "left")
    return some.unionByName(rows.join(numbers, "row", "left_anti"), allowMissingColumns=True) if all_rows else some


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) to (row, a, b): byte spans that repeat earlier text; they may touch and overlap."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(rows.sparkSession), -(-size // PART_BYTES))
    parts = n * max(1, 256 // n)  # several parts a task even out what the shuffle's hash deals unevenly
    found = "kind int, row long, a long, b long"
    first = written(rows.mapInArrow(_index_grams(parts), _EXCHANGE).repartition(n, "part").mapInArrow(_settle_grams, found), "grams")
    place = F.shiftleft("a", 16).bitwiseOR(F.col("b"))
    edges = first.filter(F.col("kind") == _EDGE).groupBy("row").agg(F.collect_set(place).alias("places"))
    contexts = _met(rows, edges, False).mapInArrow(_index_contexts(parts), _EXCHANGE)
    second = written(contexts.repartition(n, "part").mapInArrow(_settle_contexts, found), "contexts")
    return first.unionByName(second).filter(F.col("kind") == _SPAN).select("row", "a", "b")


def _cut(texts: list[bytes], spans: list) -> Iterator[tuple[int, int, int, bytes]]:
    for text, some in zip(texts, spans, strict=True):
        if not some:
            yield len(text), 0, 0, text
            continue
        a = np.array([s["a"] for s in some], np.int64)
        b = np.array([s["b"] for s in some], np.int64)
        runs = _runs(np.zeros(len(a), np.int64), a, b)
        kept, at = [], 0
        for x, y in zip(runs["a"].tolist(), runs["b"].tolist(), strict=True):
            kept.append(text[at:x])
            at = y
        kept.append(text[at:])
        yield len(text), int((runs["b"] - runs["a"]).sum()), len(runs["a"]), b"".join(kept)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        done = [(n, r, k, hashlib.sha256(kept).hexdigest()) for n, r, k, kept in _cut(texts, batch.column("spans").to_pylist())]
        cols = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = with_row_ids(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "row")
    spans = repeated_spans(rows).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return _met(rows, spans, True)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Null texts count as empty, and texts under MATCH bytes lose nothing. Rows with equal ids come in the order of the table,
    null ids after all others. An empty table gives an empty table; other columns are ignored.
    """
    return _with_spans(docs, text, doc_id).select("doc_id", "text", "spans").mapInArrow(
        _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def kept_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept): the bytes that stay of every row, as binary, for they may end within a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            kept = [k for *_, k in _cut(texts, batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    return _with_spans(docs, text, doc_id).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary")
