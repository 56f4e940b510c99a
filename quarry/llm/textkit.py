"""Vectorised text primitives over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+``. Their separators are ASCII, so UTF-8 bytes give the same words as
code points, and a whole batch is cut, hashed and counted without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: The prime 2**31 - 1, and two bases: a hash is the value of two polynomials over that field.
PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_414_213_562, 1_732_050_807)
_HALF = np.uint64(31)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers are products of two from small tables, so that what a worker keeps does not grow with its longest text.
_STEP = 16
_tables: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x mod PRIME, for x below 2**62."""
    x = (x & PRIME) + (x >> _HALF)
    x = (x & PRIME) + (x >> _HALF)
    return np.where(x >= PRIME, x - PRIME, x)


def _table(which: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """base**i, and base**(i * 2**16), for i below 2**16."""
    if (which, inverse) not in _tables:
        base, found = pow(_BASES[which], -1 if inverse else 1, int(PRIME)), []
        for b in (base, pow(base, 1 << _STEP, int(PRIME))):
            have = np.ones(1, np.uint64)
            while len(have) < 1 << _STEP:  # twice as many in each step
                have = np.concatenate([have, _fold(have * np.uint64(pow(b, len(have), int(PRIME))))])
            found.append(have)
        _tables[which, inverse] = (found[0], found[1])
    return _tables[which, inverse]


def powers(n: int, which: int) -> np.ndarray:
    """base**0 .. base**(n-1) in the field."""
    low, high = _table(which, False)
    if n <= len(low):
        return low[:n]
    return _fold(np.multiply.outer(high[: ((n - 1) >> _STEP) + 1], low).ravel()[:n])


def back(at: np.ndarray, which: int) -> np.ndarray:
    """base**-at in the field."""
    low, high = _table(which, True)
    return _fold(low[at & (len(low) - 1)] * high[at >> _STEP])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of a sequence, by prefix sums of value * base**position.

    Two polynomials over a prime field, of the values' low and high bits: unlike sums mod 2**64, no
    pattern of the text makes different ranges collide. Sums of 2**31 values fit 64 bits.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros((2, n + 1), np.uint64)
        for i, part in enumerate((values & PRIME, (values >> _HALF) & PRIME)):
            np.cumsum(_fold(part * powers(n, i)), out=self.prefix[i, 1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of [start, end); equal content has equal hashes, wherever it stands."""
        low, high = (_fold(_fold(p[end] - p[start]) * back(start, i)) for i, p in enumerate(self.prefix))
        return mix(((high << _HALF) | low) + mix((end - start).astype(np.uint64) + np.uint64(salt)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each row; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes each."""
    data, at = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def doc_ids(column: pa.Array) -> list:
    return column.to_pylist()


def count(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's range of bytes."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class Words:
    """The words of a block: byte ranges, hashes, and ``first``, where each row's words begin."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        solid = ~SPACE[data]
        self.solid = solid
        begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        if n:
            begins[0] = solid[0]
            begins[1:n] = solid[1:] & ~solid[:-1]
            ends[1:n] = solid[:-1] & ~solid[1:]
            ends[n] = solid[-1]
            edge = at[1:-1]  # a word ends with its row
            edge = edge[(edge > 0) & (edge < n)]
            edge = edge[solid[edge] & solid[edge - 1]]
            begins[edge] = ends[edge] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.starts, at)
        self.rolling = Rolling(_BYTE[data])
        self.hash = self.rolling.of(self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """How many words of its row begin at each word or after it."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all runs of ``width`` words within a row."""
        starts = np.flatnonzero(self.left() >= width)
        return starts, Rolling(self.hash).of(starts, starts + width)


def byte_hashes(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE[data])
