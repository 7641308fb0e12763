"""Words and word shingles of Arrow text columns as 64-bit hashes, by numpy over whole batches.

Words are runs of bytes other than space and 9 to 13; A-Z are folded. A word's hash is a
polynomial over a random table, mixed; a shingle's is a mixed sum of its words'. Texts are
taken in chunks of bytes, so memory follows the chunk or the longest text.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEYS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25]
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each row and in all)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(n + 1, np.uint64)
    power *= _TABLE[data]
    np.cumsum(power, out=sums[1:])
    power[:] = _INVERSE
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    h = (sums[ends] - sums[starts]) * power[starts]
    h += (ends - starts).astype(np.uint64)
    return mixed(h), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For every row, the sorted distinct hashes of its k-word shingles.

    A row of fewer than k words, but one at least, has one: its whole sequence.
    """
    words, before = word_hashes(data, offsets)
    keys = [np.uint64(x) for x in _KEYS]
    m = len(words) - k + 1
    if m > 0:
        h = words[:m] * keys[0]
        for i in range(1, k):
            h += words[i : i + m] * keys[i % len(keys)] * np.uint64(2 * (i // len(keys)) + 1)
        h = mixed(h)
    for i in range(len(offsets) - 1):
        a, b = before[i], before[i + 1]
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    short = short * keys[7] + w + np.uint64(b - a)
            yield mixed(np.array([short]))
        else:
            yield np.zeros(0, np.uint64)
