"""Zstandard dictionaries from the first records of a file."""

from __future__ import annotations

from collections.abc import Iterable

import zstandard


def first_bytes(records: Iterable[bytes], most: int) -> list[bytes]:
    """The first records, most bytes at the most; empty ones are left out."""
    sample, size = [], 0
    for x in records:
        if size >= most:
            break
        if x:
            sample.append(x[: most - size])
            size += len(sample[-1])
    return sample


def dictionary(sample: list[bytes], most: int) -> bytes:
    """A dictionary of at most so many bytes: trained on the sample or, where that is too little to train on, the sample's own last bytes as a raw dictionary. Empty only if the sample has less than eight bytes, which no frame can refer to."""
    size = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(min(most, max(256, size // 8)), sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(sample)[-most:]
        return raw if len(raw) >= 8 else b""


def loaded(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None
