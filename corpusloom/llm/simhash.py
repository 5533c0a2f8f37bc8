"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 if it is set in over half the text's shingle hashes. Bit i of a fingerprint gets a vector phi(i) in
{1, .., 2^(r+1) - 1}; for each non-zero v there is a mask of the bits with an odd inner product of phi(i) and v. Two
fingerprints that differ in at most r bits agree under some mask: r vectors can't span r + 1 dimensions, so some v is
orthogonal to phi of every differing bit, and its mask leaves them all out. That is a guarantee, not a probability.

Only distinct fingerprints are compared. Each mask's bucket is reduced to its own components, as one link per member to the
smallest, so a bucket gives fewer links than members; connected components then come from alternating stars over written
tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import OWN, forget, partitions, with_row_ids, without, written

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Members of a bucket up to which all of them are compared; beyond, every neighbour within the radius is looked up.
_COMPARED = 4096


def majority(words: np.ndarray) -> np.ndarray:
    """Rows of unsigned 64-bit words to one row of words: a bit is 1 if it is set in over half of the rows."""
    n, k = words.shape
    counts = np.zeros(BITS * k, np.int64)
    for at in range(0, n, 1 << 15):
        some = np.ascontiguousarray(words[at : at + (1 << 15)], "<u8")
        counts += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text, unsigned; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0] + [e + 1 for e in ends]
        hashes = [h(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]  # noqa: B905
    return int(majority(np.array(hashes, np.uint64)[:, None])[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """The fingerprint as a signed long; nulls count as empty."""
    return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The 2^(radius + 1) - 1 masks, unsigned."""
    n = 1 << (radius + 1)
    phi = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, n)]


def _neighbours(free: list[int], radius: int) -> np.ndarray:
    """All xor patterns of 1 to `radius` of the free bits."""
    out, level = [], {0}
    for _ in range(radius):
        level = {x ^ (1 << b) for x in level for b in free if not x >> b & 1}
        out += level
    return np.array(sorted(set(out)), np.uint64)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i[k] and j[k] in place; labels stay the smallest index of their component."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def bucket_components(members: np.ndarray, mask: int, radius: int = RADIUS) -> np.ndarray:
    """For sorted distinct fingerprints equal under `mask`: the index of the smallest of each one's component, linking
    members at most `radius` bits apart. Exact for any number of members."""
    n = len(members)
    label = np.arange(n)
    if n <= _COMPARED:
        for i in range(n - 1):
            near = i + 1 + np.flatnonzero(np.bitwise_count(members[i + 1 :] ^ members[i]) <= radius)
            if len(near):
                _merge(label, np.full(len(near), i), near)
        return label
    for pattern in _neighbours([b for b in range(BITS) if not mask >> b & 1], radius):
        other = members ^ pattern
        at = np.minimum(np.searchsorted(members, other), n - 1)
        hit = np.flatnonzero((members[at] == other) & (members < other))
        if len(hit):
            _merge(label, hit, at[hit])
    return label


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) sorted by mask and key to links (a, b), a the smallest of b's component in its bucket."""
    masks = covering_masks()
    rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def links(m: np.ndarray, k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (k[1:] != k[:-1]))))
        size = np.diff(np.append(new, len(m)))
        a, b = [], []
        for at, n in zip(new[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            members = np.unique(f[at : at + n].view(np.uint64))
            label = bucket_components(members, masks[m[at]])
            tied = np.flatnonzero(label != np.arange(len(members)))
            a.append(members[label[tied]])
            b.append(members[tied])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        m, k, f = cols
        if not len(m):
            continue
        last = np.flatnonzero((m != m[-1]) | (k != k[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from links(m[:cut], k[:cut], f[:cut])
        rest = (m[cut:], k[cut:], f[cut:])
    if rest is not None and len(rest[0]):
        yield from links(*rest)


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) whose components are those of all pairs within the radius."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(covering_masks())]))
    n = partitions(prints.sparkSession)
    return (
        prints.select(tables.alias("t"), "fp").select("t.mask", "t.key", "fp")
        .repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
        .mapInArrow(_bucket_links, "a long, b long")
    )


def components(links: DataFrame) -> DataFrame:
    """(a, b) to (node, root), root the smallest node of the component, for nodes that have links.

    Alternating large and small stars; each round is a written table, and rounds end when no link changes.
    """
    now = written(_tidy(links), "links")
    mark = _mark(now)
    while mark[0]:
        # Large star: a node's larger neighbours go to its smallest neighbour.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(_tidy(now.join(least, "a").select(F.col("m").alias("a"), "b")), "links")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
        small = written(_tidy(moved.union(least.select(F.col("m").alias("a"), "b"))), "links")
        forget(now)
        forget(large)
        now, last, mark = small, mark, _mark(small)
        if mark == last:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _tidy(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    """Tells two sets of links apart."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def near_groups(rows: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str = f"{OWN}row") -> DataFrame:
    """(row, doc_id, fp, component_id, first): the smallest id reachable by links, and whether the row is the first of its
    component by id (nulls last), then row. Null and empty texts have the fingerprint 0 and link like any other."""
    prints = written(rows.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), simhash(F.col(text)).alias("fp")), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = written(prints.groupBy("fp").agg(first.alias("first")), "prints")
    tied = written(components(near_links(distinct.select("fp"))), "components")
    known = distinct.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = known.groupBy("root").agg(F.min("first").alias("lead"))
    led = known.join(roots, "root").select("fp", "lead")
    return prints.join(led, "fp").select(
        "row", "doc_id", "fp", F.col("lead.doc_id").alias("component_id"), (F.col("row") == F.col("lead.row")).alias("first")
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: (doc_id, fingerprint, component_id); the fingerprint as 16 lower-case hex digits.

    Null and empty texts have the fingerprint 0 and link like any other. Repeated rows are rows of their own in one
    component; of ids that are null none is the smallest unless the component has no other. An empty table gives an empty
    one; further columns are not read.
    """
    found = near_groups(with_row_ids(docs.select(doc_id, text)), text, doc_id)
    hexed: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The first row of each component, with all its columns; odd rows are treated as by near_duplicates()."""
    rows = with_row_ids(docs)
    dropped = written(near_groups(rows, text, doc_id).filter("not first").select("row"), "near-copies")
    return without(rows, dropped).drop(f"{OWN}row")
