"""Words of whole texts as 64-bit hashes, taken from Arrow's bytes a slice of rows at a time.

A word is a run of bytes that are no ASCII white space. Its hash is a polynomial of its bytes, summed by position and
brought back to the word's start, so a slice costs a few passes over its bytes and nothing is kept between slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a slice of rows, about; a longer text is a slice of its own.
SLICE = 1 << 18
#: Words from here on are hashed one by one.
LONG = 4096
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15


def values(lower: bool) -> np.ndarray:
    """Byte -> its part in the hash: 0 for white space; A-Z count as a-z if ``lower``."""
    out = np.arange(1, 257, dtype=np.uint64)
    if lower:
        out[65:91] += np.uint64(32)
    out[BLANK] = 0
    return out


def powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


LOWER, EXACT = values(True), values(False)
POWER, INVERSE = powers(BASE, SLICE + LONG), powers(pow(BASE, -1, 1 << 64), SLICE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, over unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets of the texts in them) of consecutive rows of an Arrow string column without nulls."""
    import pyarrow as pa

    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of a slice, and where each text's words begin among them (one more than texts)."""
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    inside, edge = ~BLANK[data], np.ones(len(data) + 1, bool)
    edge[1:-1] = ~inside[:-1]
    edge[begins] = True
    start = np.flatnonzero(inside & edge[:-1])
    edge[:-2] = ~inside[1:]
    edge[begins[1:] - 1] = True
    edge[-2:] = True
    end = np.flatnonzero(inside & edge[:-1]) + 1
    hashes = np.empty(len(start), np.uint64)
    for at in range(0, len(data), SLICE):
        lo, hi = np.searchsorted(start, (at, at + SLICE))
        if lo < hi:
            part = table[data[at : at + SLICE + LONG]]
            part *= POWER[: len(part)]
            cut = start[lo : hi + 1] - at
            cut = cut[cut < len(part)]
            hashes[lo:hi] = np.add.reduceat(part, cut)[: hi - lo] * INVERSE[cut[: hi - lo]]
    for i in np.flatnonzero(end - start > LONG).tolist():
        hashes[i] = long_hash(data[start[i] : end[i]], table)
    hashes = mix(hashes ^ ((end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return start, end, hashes, np.searchsorted(start, offsets)


def long_hash(word: np.ndarray, table: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest((table[word] - np.uint64(1)).astype(np.uint8).tobytes())
