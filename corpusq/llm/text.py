"""Vectorised words and word hashes over Arrow string columns, shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are what stands between these bytes: [\x20\x09-\x0D].
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words are runs of [0-9a-z] and of code points from 0x80, once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, at least one text each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of the texts i to j: ``first`` holds n + 1 offsets into the words; bytes are lower-cased in A-Z."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, i: int, j: int, table: np.ndarray = SPACED, lower: bool = True):
        a, b = int(off[i]), int(off[j])
        self.bytes = np.zeros(b - a + 8, np.uint8)
        self.bytes[: b - a] = LOWER[buf[a:b]] if lower else buf[a:b]
        bounds = off[i : j + 1] - a
        inside = table[self.bytes[: b - a]]
        edges = np.zeros(b - a + 1, bool)
        edges[bounds] = True
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges[:-1]] = False
        after[edges[1:]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.lengths = np.flatnonzero(inside & ~after) + 1 - self.starts
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.bytes, self.starts, self.lengths)


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; ``data`` ends in eight bytes of padding."""
    at8 = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), shape=(max(1, len(data) - 7),), strides=(1,))
    out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.flatnonzero(lengths <= LONG_WORD)
    k = 0
    while len(live):
        rest = lengths[live] - 8 * k
        chunk = at8[starts[live] + 8 * k]
        short = rest < 8
        chunk[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix(out[live] ^ chunk) + np.uint64(0x632BE59BD9B4E019)
        live = live[rest > 8]
        k += 1
    for w in np.flatnonzero(lengths > LONG_WORD):
        digest = hashlib.blake2b(data[starts[w] : starts[w] + lengths[w]].tobytes(), digest_size=8).digest()
        out[w] = int.from_bytes(digest, "little")
    return out
