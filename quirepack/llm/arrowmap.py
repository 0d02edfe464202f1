"""Arrow-batched maps and files in the shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import freed

#: Bytes of text that are computed and given back at a time: a worker holds a batch of up to 64 MB, but not its results.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, text: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of a text column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, most + (ends[i - 1] if i else 0), side="right")))
        yield batch.slice(i, j - i)
        i = j


def mapped(compute: Callable[[pa.RecordBatch], list[pa.Array]], kept: Sequence[str], added: Sequence[str], text: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map that gives the kept columns of batches, and added ones by compute; with a text column, in parts() of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text) if text else [batch]:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *compute(part)], names=[*kept, *added])
        freed()

    return run


def with_columns(df: DataFrame, fields: Sequence[StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], text: str | None = None, gone: Sequence[str] = ()) -> DataFrame:
    """df with columns computed from Arrow batches, or from parts of them if a text column is named; columns of the same names are replaced, those in gone only computed from."""
    names = {f.name.lower() for f in fields}
    df = df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in names))
    kept = [f for f in df.schema.fields if f.name not in gone]
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in kept), *fields])
    return df.mapInArrow(mapped(compute, [f.name for f in kept], [f.name for f in fields], text), schema)


def published(folder: str, name: str, parts: Iterator[bytes]) -> None:
    """Writes a file under a temporary name and moves it into place: a repeated task attempt replaces it whole."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as out:
        for part in parts:
            out.write(part)
    fs.move(hidden, f"{root}/{name}")


def stored(spark: SparkSession, folder: str, pattern: str, manifest: DataFrame) -> DataFrame:
    """(file, content) of the files in a folder, after a look at their names: one that the manifest (file) has and the folder has not is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(uri(folder)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    gone = manifest.select("file").join(found.select("file"), "file", "left_anti").first()
    if gone:
        raise FileNotFoundError(f"{folder} has no file {gone[0]}")
    return found


def uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)
