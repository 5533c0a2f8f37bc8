"""FNV-1a, 64 bits, as 16 lower-case hex digits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash.
OFFSET = 14695981039346656037
PRIME = 1099511628211

_MASK = (1 << 64) - 1
_LOW = (1 << 40) - 1
#: Values at a time under which a loop over bytes is quicker than a vector step per byte.
_FEW = 24


def fnv1a64(data: bytes, state: int = OFFSET) -> int:
    for byte in data:
        state = ((state ^ byte) * PRIME) & _MASK
    return state


def fnv1a64_many(values: list[bytes]) -> list[int]:
    """The hashes of many values: one vector step per byte position, over all values that are long enough."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    size = np.array([len(values[i]) for i in order], np.int64)
    state = np.full(len(values), OFFSET, np.uint64)
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    start = np.cumsum(size) - size
    active, at = int((size > 0).sum()), 0
    while active > _FEW:
        stop = int(size[active - 1])
        places = start[:active] + at
        head = state[:active]
        for step in range(stop - at):
            head ^= data[places + step]
            head *= np.uint64(PRIME)
        at, active = stop, int((size > stop).sum())
    out = [0] * len(values)
    for k, i in enumerate(order):
        s = int(state[k])
        out[i] = fnv1a64(values[i][at:], s) if k < active else s
    return out


#: Bytes that a stream is hashed by.
BLOCK = 1 << 16
_POWERS = np.cumprod(np.concatenate(([1], np.full(BLOCK, PRIME, np.uint64))), dtype=np.uint64)


class Fnv1a64:
    """The hash of a stream, block by block in vector steps; its memory doesn't depend on the stream's length.

    A byte only changes the low byte of the state, which alone decides the next low byte. So the low bytes of a block come
    first: bit by bit, since a product with an odd number passes a bit on as it is, but for what lower bits add, and running
    exclusive-or gives each bit at all places. Then the state is a sum of the changes times powers of the prime.
    """

    def __init__(self, state: int = OFFSET) -> None:
        self.state = state

    def update(self, data: bytes | memoryview) -> Fnv1a64:
        whole = np.frombuffer(data, np.uint8)
        for at in range(0, len(whole), BLOCK):
            self._block(whole[at : at + BLOCK])
        return self

    def _block(self, data: np.ndarray) -> None:
        n = len(data)
        low = np.zeros(n + 1, np.uint8)  # of the state before each byte, and after the last
        low[0] = self.state & 255
        for k in range(8):
            lower = (low[:-1] ^ data) & np.uint8((1 << k) - 1)
            flips = ((data >> k) ^ (lower * np.uint8(PRIME & 255) >> k)) & np.uint8(1)
            low[1:] |= (np.bitwise_xor.accumulate(flips) ^ (low[0] >> k & np.uint8(1))) << k
        change = (low[:-1] ^ data).astype(np.int64) - low[:-1]
        total = int((change.view(np.uint64) * _POWERS[n:0:-1]).sum(dtype=np.uint64))
        self.state = (self.state * int(_POWERS[n]) + total) & _MASK

    def hexdigest(self) -> str:
        return f"{self.state:016x}"


@F.pandas_udf(T.StringType())
def _hashed(data: pd.Series) -> pd.Series:
    known = data.notna()
    out = pd.Series([None] * len(data), dtype=object)
    out[known.to_numpy()] = [f"{h:016x}" for h in fnv1a64_many([bytes(x) for x in data[known]])]
    return out


def content_hash(data: Column) -> Column:
    """The hash of a binary or text column, null for null. Arrow batches, vectorised over the rows of a batch."""
    return _hashed(data.cast("binary"))


def _hash_step(state: str, byte: str) -> str:
    """The state after a byte, in 64 bits without an overflow: the prime is 2^40 + 435, and the low 40 bits carry into the rest."""
    low = f"(({state} ^ {byte}) & {_LOW}L)"
    product = f"({low} * {PRIME & _LOW}L)"
    return f"(shiftleft(shiftrightunsigned({state}, 40) * {PRIME & _LOW}L + shiftrightunsigned({product}, 40) + {low}, 40) | ({product} & {_LOW}L))"


def content_hash_sql(data: str) -> Column:
    """The same as a JVM expression over a binary column's name, for data where a Python worker isn't wanted: a fold over numbers
    of eight bytes each, and then over the last bytes one by one."""
    size = f"octet_length({data})"
    numbers = lambda starts, n: f"transform({starts}, i -> cast(conv(hex(substring({data}, i, {n})), 16, -10) AS bigint))"
    eights = f"CASE WHEN {size} < 8 THEN array() ELSE {numbers(f'sequence(1, {size} - 7, 8)', 8)} END"
    ones = f"CASE WHEN {size} % 8 = 0 THEN array() ELSE {numbers(f'sequence({size} - {size} % 8 + 1, {size})', 1)} END"
    parts = ", ".join(f"shiftright(v, {k}) & 255L" for k in range(56, -1, -8))
    state = f"aggregate({eights}, {OFFSET - (1 << 64)}L, (s, v) -> aggregate(array({parts}), s, (t, x) -> {_hash_step('t', 'x')}))"
    return F.expr(f"CASE WHEN {data} IS NOT NULL THEN lower(lpad(hex(aggregate({ones}, {state}, (s, x) -> {_hash_step('s', 'x')})), 16, '0')) END")


def hash_bucket(hexed: Column, buckets: int = 65_536) -> Column:
    """The bucket of a hash in hex digits, for a power of two of buckets up to 2^60: its low bits."""
    return F.conv(F.right(hexed, F.lit(15)), 16, 10).cast("long") % buckets
