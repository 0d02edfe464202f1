"""Encoders as a codec table, raced inside one Arrow map.

All codecs give raw DEFLATE. Three of the four are stand-ins: the encoders that
they replace (libdeflate, an optimal-parsing encoder and an iterative one) are not
installed here, so "fast" is zlib at the given level, at most 9, "ect" the best of
two zlib strategies and "turtle" the best of several strategies and memory levels.
"zlib" is the same algorithm as the original. Rules for choosing, storing and
accounting do not depend on which codecs are in the table.

A payload is read once and tried by all its encoders in the same task; only sizes,
checksums and the chosen bytes leave it. A codec that fails gives None. Each candidate
carries the checksum of what its bytes inflate to: encoders that saw different bytes
make the run fail. Payloads for zlib alone can also be encoded a chunk at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirepack.operators.entries import PRIORITY

EMPTY = b"\x03\x00"
STORED, DEFLATED = 0, 8
CHUNK = 1 << 20


def _deflate(data: bytes, level: int, memory: int = 8, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15, memory, strategy)
    return packer.compress(data) + packer.flush()


def _best(data: bytes, settings: list[tuple[int, int, int]]) -> bytes:
    return min((_deflate(data, *s) for s in settings), key=len)


Codec = Callable[[bytes, dict], bytes | None]
CODECS: dict[str, Codec] = {
    "fast": lambda data, policy: _deflate(data, min(policy["fast_level"], 9)),
    "ect": lambda data, policy: _best(data, [(9, 8, zlib.Z_DEFAULT_STRATEGY), (9, 8, zlib.Z_FILTERED)]),
    "turtle": lambda data, policy: _best(data, [(9, m, s) for m in (8, 9) for s in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED, zlib.Z_FIXED)]),
    "zlib": lambda data, policy: _deflate(data, min(policy["zlib_level"], 9)),
}


RACE_SCHEMA = "ordinal long, name string, size long, crc long, method int, engine string, compressed long, candidates array<struct<engine:string,compressed:long,crc:long>>, data binary"
RACE_NAMES = [x.split()[0] for x in RACE_SCHEMA.split(", ")]
RACE_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.struct([("engine", pa.string()), ("compressed", pa.int64()), ("crc", pa.int64())])), pa.binary()]


def inflated_crc(packed: bytes) -> int:
    """The checksum of what raw DEFLATE bytes inflate to, a piece at a time."""
    unpack, crc, rest = zlib.decompressobj(-15), 0, packed
    while True:
        piece = unpack.decompress(rest, CHUNK)
        crc, rest = zlib.crc32(piece, crc), unpack.unconsumed_tail
        if unpack.eof or not (piece or rest):
            return crc


def deflate_chunks(chunks: Iterable[bytes], level: int) -> tuple[bytes, int, int]:
    """The DEFLATE bytes of a payload that comes in chunks, its length and its checksum; a chunk is held at a time."""
    packer, out, size, crc = zlib.compressobj(level, zlib.DEFLATED, -15, 8), [], 0, 0
    for chunk in chunks:
        out.append(packer.compress(chunk))
        size, crc = size + len(chunk), zlib.crc32(chunk, crc)
    out.append(packer.flush())
    return b"".join(out), size, crc


def encode_one(data: bytes, policy: dict, codecs: dict[str, Codec] = CODECS) -> tuple[list[tuple[str, int | None, int | None]], str | None, int, bytes]:
    """All candidates (encoder, size, checksum of what it inflates to), the chosen encoder (None: stored), the method and the member's bytes."""
    after = policy["zlib_after"]
    alone = after is not None and len(data) >= after
    tried, best = [], None
    for name in ["zlib"] if alone else [e for e in ("fast", "ect", "turtle") if e in policy["engines"]]:
        packed = EMPTY if not data else codecs[name](data, policy)
        tried.append((name, None, None) if packed is None else (name, len(packed), inflated_crc(packed)))
        if packed is not None and (best is None or (len(packed), PRIORITY[name]) < (len(best[1]), PRIORITY[best[0]])):
            best = name, packed
    if best and (alone or not data or len(best[1]) < len(data)):
        return tried, best[0], DEFLATED, best[1]
    return tried, None, STORED, data




def spread(df: DataFrame) -> DataFrame:
    """df in a partition for each core at least: a small file is one partition, however much work its rows make. A large one is not dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def race(entries: DataFrame, policy: dict, codecs: dict[str, Codec] = CODECS, keep_data: bool = True, strict: bool = True) -> DataFrame:
    """From (ordinal, name, payload): one row an entry with the winner and all candidates. A null payload is empty.

    strict: candidates that do not inflate to the payload make the run fail; else their checksums only show it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ordinal, name, payload, crc in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = payload or b""
                tried, engine, method, packed = encode_one(data, policy, codecs)
                if strict and any(c not in (None, crc) for _, _, c in tried):
                    raise ValueError(f"encoders saw different bytes of {name!r}")
                rows.append((ordinal, name, len(data), crc, method, engine, len(packed), [{"engine": e, "compressed": s, "crc": c} for e, s, c in tried], packed if keep_data else None))
            columns = zip(*rows) if rows else [[]] * len(RACE_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, RACE_KINDS)], names=RACE_NAMES)

    crc = F.crc32(F.coalesce(F.col("payload"), F.lit(b""))).cast("long")
    return spread(entries.select("ordinal", "name", "payload", crc.alias("crc"))).mapInArrow(run, RACE_SCHEMA)
