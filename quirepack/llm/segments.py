"""Token ids of texts through a cache of their segments.

Texts are cut where the tokenizer can never join across; equal segments then
have equal ids. Each distinct segment of a batch is looked up, new ones are
encoded together, and the ids of whole texts are gathered from one flat store.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Segments kept in a worker (some 35 MB) until the cache starts anew.
MOST = 200_000
#: Longer segments are not kept.
LONGEST = 64


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i]:starts[i] + counts[i]], one after the other."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class SegmentIds:
    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST) -> None:
        """encode: segments to their ids, one after the other, and each one's number of ids; most: segments kept."""
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, segments: list[bytes]) -> None:
        flat, counts = self.encode(segments)
        first = len(self.counts)
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
        self.counts, self.flat = np.append(self.counts, counts), np.append(self.flat, flat)
        self.slots.update((s, first + i) for i, s in enumerate(segments) if len(s) <= LONGEST)

    def ids(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the segments data[cuts[i]:cuts[i + 1]], one after the other, and each segment's number of ids."""
        if len(cuts) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.counts) > self.most:
            self._clear()
        array = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int32)), pa.py_buffer(data)])
        coded = array.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = np.fromiter(map(self.slots.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.counts) + np.arange(len(new))
            self._add([distinct[i] for i in new.tolist()])
        slot = found[coded.indices.to_numpy()]
        counts = self.counts[slot]
        return gathered(self.flat, self.starts[slot], counts), counts
