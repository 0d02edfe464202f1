"""Entries from the file system.

Directories are walked in sorted order (the order that a directory gives them in
differs between machines); symbolic links found on the way are skipped, named ones
are followed. Metadata is taken once; payloads are read later, in tasks, and must
still have the size that was seen.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quirepack.functions.names import MOST_NAME_BYTES, mask_regex, name_flags
from quirepack.operators.encode import CHUNK, DEFLATED, RACE_KINDS, RACE_NAMES, RACE_SCHEMA, deflate_chunks, inflated_crc

ENTRY_SCHEMA = "ordinal long, path string, raw_name binary, name string, name_len int, flags int, mode long, size long, mtime double, dev long, ino long, raw_path binary"


#: The place of the size in a row of ENTRY_SCHEMA.
SIZE_AT = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")].index("size")


class InputError(ValueError):
    """An input that cannot be archived."""


def _matches(path: str, masks: list[str]) -> bool:
    import re

    return not masks or any(re.fullmatch(mask_regex(m), path if "/" in m else path.rpartition("/")[2]) for m in masks)


def _walk(directory: str, prefix: str, recursive: bool) -> Iterator[tuple[str, str, os.stat_result]]:
    """(path, path below the start, status) of regular files."""
    with os.scandir(directory) as found:
        for one in sorted(found, key=lambda e: e.name):
            below = f"{prefix}/{one.name}" if prefix else one.name
            if one.is_symlink():
                continue
            if one.is_dir(follow_symlinks=False):
                if recursive:
                    yield from _walk(one.path, below, True)
            elif one.is_file(follow_symlinks=False):
                yield one.path, below, one.stat(follow_symlinks=False)


def discover(inputs: list[str], recursive: bool, literal_from: int = 1 << 30, archive: str | None = None) -> list[tuple]:
    """Rows of ENTRY_SCHEMA for the inputs of a command line: files, directories and @masks."""
    masks = [x[1:] for i, x in enumerate(inputs) if x.startswith("@") and i < literal_from]
    sources = [x for i, x in enumerate(inputs) if not (x.startswith("@") and i < literal_from)]
    if "" in masks:
        raise InputError("an empty mask")
    own = os.stat(archive) if archive and os.path.exists(archive) else None
    rows, seen = [], set()

    def add(path: str, status: os.stat_result, explicit: bool) -> None:
        if own and (own.st_dev, own.st_ino) == (status.st_dev, status.st_ino):
            if explicit:
                raise InputError(f"the archive cannot be in itself: {path}")
            return
        name = path
        while name.startswith("./"):
            name = name[2:]
        raw = os.fsencode(name)
        parts = raw.removesuffix(b"/").split(b"/")
        if not raw or any(p in (b"", b"..") for p in parts) or len(raw) > MOST_NAME_BYTES or status.st_size > 2**32 - 1 or not stat.S_ISREG(status.st_mode):
            raise InputError(f"cannot add {path}")
        if raw in seen:
            if explicit:
                raise InputError(f"duplicate entry: {path}")
            return
        seen.add(raw)
        if len(seen) > 65_535:
            raise InputError("more than 65535 files")
        try:
            raw.decode()
            flags = 0x0800
        except UnicodeDecodeError:
            flags = 0
        # tasks do not run in the driver's working directory
        whole = os.path.abspath(path)
        rows.append((len(rows), whole if flags else None, raw, raw.decode(errors="replace"), len(raw), flags, status.st_mode, status.st_size, status.st_mtime, status.st_dev, status.st_ino, os.fsencode(whole)))

    if not sources:
        masks = masks or ["*"]
        for path, below, status in _walk(".", "", recursive):
            if _matches(below, masks):
                add(below, status, False)
    for source in sources:
        status = os.stat(source)
        if recursive and stat.S_ISDIR(status.st_mode):
            base = source.rstrip("/") or "/"
            for path, below, found in _walk(base, "", True):
                if _matches(below, masks):
                    add(below if base == "." else path, found, False)
        elif recursive:
            if _matches(source, masks):
                add(source, status, False)
        else:
            add(source, status, True)
    if not rows:
        raise InputError("no files to archive")
    return rows


def entries(spark: SparkSession, rows: list[tuple], partitions: int | None = None) -> DataFrame:
    """The discovered rows as a DataFrame, dealt out for reading."""
    df = spark.createDataFrame(rows, ENTRY_SCHEMA).withColumn("flags", name_flags(F.col("raw_name")))
    return df.repartition(partitions or spark.sparkContext.defaultParallelism)


def chunks(f, size: int, path, step: int = CHUNK) -> Iterator[bytes]:
    """The bytes of an open file, a chunk at a time. It must end where it ended when its size was seen."""
    left = size
    while left:
        piece = f.read(min(left, step))
        if not piece:
            raise InputError(f"file changed while it was read: {path!r}")
        left -= len(piece)
        yield piece
    if f.read(1):
        raise InputError(f"file changed while it was read: {path!r}")


def deflated(df: DataFrame, level: int) -> DataFrame:
    """Members of RACE_SCHEMA for zlib alone, read and encoded a chunk at a time: inputs of any length take a chunk and their encoded bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ordinal, name, path, size in zip(*(batch.column(c).to_pylist() for c in ("ordinal", "name", "raw_path", "size"))):
                with open(path, "rb") as f:
                    packed, total, crc = deflate_chunks(chunks(f, size, path), min(level, 9))
                tried = [{"engine": "zlib", "compressed": len(packed), "crc": inflated_crc(packed)}]
                if tried[0]["crc"] != crc:
                    raise ValueError(f"encoders saw different bytes of {name!r}")
                row = (ordinal, name, total, crc, DEFLATED, "zlib", len(packed), tried, packed)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, RACE_KINDS)], names=RACE_NAMES)

    return df.select("ordinal", "name", "raw_path", "size").mapInArrow(run, RACE_SCHEMA)


def with_payload(df: DataFrame) -> DataFrame:
    """df with payload: the file's bytes, of exactly the size seen before."""
    schema = StructType([*df.schema.fields, StructField("payload", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one payload at a time
                row = batch.slice(i, 1)
                path, size = row.column("raw_path")[0].as_py(), row.column("size")[0].as_py()
                with open(path, "rb") as f:
                    data = b"".join(chunks(f, size, path))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*batch.schema.names, "payload"])

    return df.mapInArrow(run, schema)
