"""Vectorised word scanning of Arrow string columns.

Texts are read straight from the Arrow buffers: words are byte ranges, word
identities are 64-bit hashes, and k-word sequences are hashed by prefix sums
modulo 2**64. Work is done in blocks of whole documents (BLOCK_BYTES unless a
single document is larger), so memory does not follow the batch or the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _lut(separators, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[0x41:0x5B] += 32
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    return fold, word[fold]


#: Words are runs of anything but ASCII white space.
SPACED = _lut([0x20, *range(0x09, 0x0E)], lower=False)
SPACED_LOWER = _lut([0x20, *range(0x09, 0x0E)], lower=True)
#: Words are runs of ASCII letters (folded to lower case), digits and all non-ASCII.
ALNUM_LOWER = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _U(_MULT))


class Block:
    """Words of consecutive documents: data, their byte ranges, and bounds[d]:bounds[d + 1] as the words of document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, rules) -> None:
        fold, is_word = rules
        self.raw, self.data, self.first, self.offsets = data, fold[data] if rules is not SPACED else data, first, offsets
        self.docs = len(offsets) - 1
        inside = is_word[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        if len(data):
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < len(data))]
            begins[edge] |= inside[edge]
            ends[edge - 1] |= inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's (folded) bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = np.diff(np.append(self.starts, len(self.data)))
        tail = self.data[self.starts[0] :]
        at = np.arange(len(tail), dtype=np.int64)
        at -= np.repeat(self.starts - self.starts[0], lengths)
        part = _SEEDS[((at & 63) << 8) | tail]
        if len(at) and int(at.max()) > 63:
            far = at > 63
            part[far] = mix(part[far] + (at[far] >> 6).astype(np.uint64) * _U(_MULT))
        part[~self._inside[self.starts[0] :]] = 0
        out = np.add.reduceat(part, self.starts - self.starts[0])
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all k-word windows that lie in one document, and their hashes."""
        n = len(hashes)
        room = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(n)
        at = np.flatnonzero(room >= k)
        return at, sequence_hashes(hashes, at, k)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def words(self, d: int) -> list[bytes]:
        return [self.word(i) for i in range(self.bounds[d], self.bounds[d + 1])]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _MULT, np.uint64)
    down = np.full(n, pow(_MULT, -1, 1 << 64), np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def sequence_hashes(hashes: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hashes of the sequences of the given length (a number or an array) that start at the given words."""
    up, down = _powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:], dtype=np.uint64)
    return mix((sums[at + length] - sums[at]) * down[at] + mix(np.asarray(length, dtype=np.uint64).reshape(-1) + _U(77)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, rules, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's documents in blocks; first is the index of a block's first document."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        own = offsets[i : j + 1]
        yield Block(data[own[0] : own[-1]], own - own[0], i, rules)
        i = j
