"""BLAKE2b of 8 bytes over whole Arrow batches, in 64-bit array arithmetic: one pass for all values, not a call for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the published function (RFC 7693): initial words, and the order of message words in each round.
_IV = (
    0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1,
    0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179,
)
_SIGMA = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)
_MIXES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_BLOCK, _ROUNDS, _SIZE = 128, 12, 8
#: Values that are worked on at once.
_ROWS = 1 << 15


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint64(by)) | (x << np.uint64(64 - by))


def _compress(state: list[np.ndarray], words: np.ndarray, seen: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The state of each value after one more block of 16 words; ``seen`` bytes so far, ``last`` flags."""
    n = len(seen)
    v = [*state, *(np.full(n, x, np.uint64) for x in _IV)]
    v[12] ^= seen
    v[14] ^= np.where(last, ~np.uint64(0), np.uint64(0))
    for r in range(_ROUNDS):
        order = _SIGMA[r % len(_SIGMA)]
        for k, (a, b, c, d) in enumerate(_MIXES):
            v[a] = v[a] + v[b] + words[:, order[2 * k]]
            v[d] = _turn(v[d] ^ v[a], 32)
            v[c] = v[c] + v[d]
            v[b] = _turn(v[b] ^ v[c], 24)
            v[a] = v[a] + v[b] + words[:, order[2 * k + 1]]
            v[d] = _turn(v[d] ^ v[a], 16)
            v[c] = v[c] + v[d]
            v[b] = _turn(v[b] ^ v[c], 63)
    return [h ^ v[i] ^ v[i + 8] for i, h in enumerate(state)]


def blake2b_64(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Digests, as big-endian numbers, of the byte ranges data[at[i]:at[i + 1]]. Longer ones take more rounds of their own."""
    out = np.zeros(len(at) - 1, np.uint64)
    sizes = np.diff(at)
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    order = np.argsort(blocks, kind="stable")  # so that values that go on are at the end
    for lo in range(0, len(order), _ROWS):
        rows = order[lo : lo + _ROWS]
        state = [np.full(len(rows), x, np.uint64) for x in _IV]
        state[0] ^= np.uint64(0x01010000 ^ _SIZE)
        for b in range(int(blocks[rows[-1]])):
            live = np.flatnonzero(blocks[rows] > b)
            own, left = rows[live], np.clip(sizes[rows[live]] - b * _BLOCK, 0, _BLOCK)
            padded = np.zeros((len(live), _BLOCK), np.uint8)
            inside = np.arange(_BLOCK)[None] < left[:, None]
            start = at[own] + b * _BLOCK
            padded[inside] = data[np.repeat(start - np.cumsum(left) + left, left) + np.arange(left.sum())]
            last = blocks[own] == b + 1
            seen = np.where(last, sizes[own], (b + 1) * _BLOCK).astype(np.uint64)
            after = _compress([h[live] for h in state], padded.view("<u8"), seen, last)
            for h, x in zip(state, after, strict=True):
                h[live] = x
        out[rows] = state[0].astype("<u8").byteswap().view("<u8") if np.little_endian else state[0].byteswap()
    return out


def hashes(values: list[str] | pa.Array) -> np.ndarray:
    """Digests of texts in UTF-8; a null counts as empty."""
    column = values if isinstance(values, pa.Array) else pa.array(values, pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return blake2b_64(np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8), at)


def stable_hash(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, hash, bits): the digest as 16 digits and as a signed number, the same in every process and on every machine."""

    def run(batches):
        for b in batches:
            x = hashes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{h:016x}" for h in x.tolist()]), pa.array(x.view(np.int64))], [key, "hash", "bits"])

    return rows.select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, hash string, bits bigint")
