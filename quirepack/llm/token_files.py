"""Token ids in binary files: documents compressed one by one with a shared dictionary.

File format (all numbers little-endian):

  "QPIDS1\\0\\0"  u32 width of an id in bytes (2 or 4)  u32 dictionary length
  32 bytes SHA-256 of the dictionary, the dictionary
  one zstandard frame for each document: its ids
  index, one entry a document: i64 key, u8 1 if the key is null, u64 offset, u32 length, u64 ids
  u64 offset of the index  u64 documents  u64 ids  "QPIDSEND"

The dictionary is trained on the serialized ids of the first documents of the
file, TRAIN_BYTES at most (a bounded sample by design; where they are too few to
train on, their last bytes are the dictionary), and shared by all its documents. A reader finds a document through the
index alone and checks the dictionary by its hash.

Documents are range-partitioned by key, sorted, and written in ascending order,
null keys first; equal keys follow each other by text hash. A null text has no
ids but the end id. Files are moved into place whole, so repeated task attempts
do no harm; files are read by the manifest that the write returns, and one that is
gone or has another number of documents is an error. Reading gives each document's place among all ids by adding the
totals of the files before its own.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrowmap import published, stored, uri
from .dictionaries import dictionary, first_bytes, loaded
from .segments import SegmentIds, gathered
from .shared import freed, new_folder, written
from .textscan import SPACED, blocks

MAGIC, END = b"QPIDS1\0\0", b"QPIDSEND"
ENTRY = struct.Struct("<qBQIQ")
TRAIN_BYTES = 1 << 20
DICT_BYTES = 32 << 10
FILE_BYTES = 24 << 20
LEVEL = 3
#: Words whose ids a worker keeps (some 100 MB).
WORDS_KEPT = 500_000
#: Words of letters that are encoded as one text.
TOGETHER = 24
_LETTER, _MARK, _UPPER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[list(b".,;:!?")] = True


class WordIds:
    """Ids of a tokenizer that drops white space: words have ids of their own."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.word_end = np.zeros(self.size, bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.cache = SegmentIds(self._encode, WORDS_KEPT)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the fast form leaves out offsets, not ids
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters below U+0100 are encoded some together: each has one id that ends a word, its last one. Others are encoded alone."""
        texts = [w.strip().decode() for w in words]
        plain = np.fromiter((t.isalpha() and (t.isascii() or max(t) < "\u0100") for t in texts), bool, len(texts))
        letters, others = [texts[i] for i in np.flatnonzero(plain)], [texts[i] for i in np.flatnonzero(~plain)]
        flat, _ = self._batch([" ".join(letters[i : i + TOGETHER]) for i in range(0, len(letters), TOGETHER)])
        ends = np.flatnonzero(self.word_end[flat]) + 1
        if len(ends) == len(letters):
            sizes = np.diff(np.append(0, ends))
        else:  # a vocabulary without marks of word ends
            flat, sizes = self._batch(letters)
        more, other_sizes = self._batch(others)
        counts, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        counts[plain], counts[~plain] = sizes, other_sizes
        starts[plain], starts[~plain] = np.cumsum(sizes) - sizes, len(flat) + np.cumsum(other_sizes) - other_sizes
        return gathered(np.append(flat, more), starts, counts), counts

    def _folded(self, raw: np.ndarray) -> np.ndarray:
        """raw with A-Z in lower case where the tokenizer lower-cases anyway, so that both cases share a look-up.

        Letters before other than ASCII stay, since they may be composed first;
        so do texts with special tokens' brackets, which are matched by case.
        """
        if not self.lowers or b"<|" in raw.tobytes():
            return raw
        fold = _UPPER[raw]
        fold[:-1] &= raw[1:] < 0x80
        return raw + (fold.view(np.uint8) << 5)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for block in blocks(column, SPACED, 4 << 20):
            if len(block.starts):
                # the tokenizer also splits between a letter and a mark, so words and marks can be looked up apart
                begins = np.zeros(len(block.raw), bool)
                begins[1:] = _LETTER[block.raw[:-1]] & _MARK[block.raw[1:]]
                begins[block.starts] = True
                cuts = np.flatnonzero(begins)
                flat, counts = self.cache.ids(self._folded(block.raw), np.append(cuts, len(block.raw)))
                ends = np.append(0, np.cumsum(counts))[np.searchsorted(cuts, block.offsets)]
            else:
                flat, ends = np.zeros(0, np.int32), np.zeros(block.docs + 1, np.int64)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield flat[a:b]


_tokenizers: dict[str, WordIds] = {}


def tokenizer_of(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def file_parts(documents: list[tuple[int | None, bytes]], width: int) -> Iterator[bytes]:
    """The bytes of one file."""
    trained = dictionary(first_bytes((ids for _, ids in documents), TRAIN_BYTES), DICT_BYTES)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded(trained))
    head = MAGIC + struct.pack("<II", width, len(trained)) + hashlib.sha256(trained).digest() + trained
    yield head
    at, total, index = len(head), 0, []
    for key, ids in documents:
        frame = packer.compress(ids)
        index.append(ENTRY.pack(key or 0, key is None, at, len(frame), len(ids) // width))
        at, total = at + len(frame), total + len(ids) // width
        yield frame
    yield b"".join(index) + struct.pack("<QQQ", at, len(index), total) + END


class IdFile:
    """A reader of one file's bytes; document(i) reads a single document."""

    def __init__(self, data) -> None:
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC or bytes(self.data[-8:]) != END:
            raise ValueError("not an id file")
        self.width, n = struct.unpack("<II", self.data[8:16])
        trained = bytes(self.data[48 : 48 + n])
        if hashlib.sha256(trained).digest() != bytes(self.data[16:48]):
            raise ValueError("the dictionary does not have its hash")
        self.index, self.count, self.total = struct.unpack("<QQQ", self.data[-32:-8])
        self.unpacker = zstandard.ZstdDecompressor(dict_data=loaded(trained))

    def __len__(self) -> int:
        return self.count

    def entry(self, i: int):
        key, null, at, length, n = ENTRY.unpack_from(self.data, self.index + i * ENTRY.size)
        return (None if null else key), at, length, n

    def document(self, i: int) -> np.ndarray:
        _, at, length, n = self.entry(i)
        ids = np.frombuffer(self.unpacker.decompress(self.data[at : at + length]), f"<u{self.width}")
        if len(ids) != n:
            raise ValueError("a document has another length than its index entry")
        return ids


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files; returns the manifest (file, documents, ids), written already."""
    folder = uri(folder)
    ordered = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("key", "h").sortWithinPartitions("key", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_of(tokenizer)
        width = 2 if max(own.size, end_id + 1) <= 1 << 16 else 4
        part, names, counts, totals = TaskContext.get().partitionId(), [], [], []
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                names.append(f"part-{part:07d}-{len(names):05d}.ids")
                published(folder, names[-1], file_parts(held, width))
                counts.append(len(held))
                totals.append(size // width)
            held, size = [], 0

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1))):
                raw = np.append(ids, end_id).astype(f"<u{width}").tobytes()
                if size + len(raw) > FILE_BYTES:
                    flush()
                held.append((k, raw))
                size += len(raw)
        flush()
        freed()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(totals, pa.int64())], ["file", "documents", "ids"])

    return written(ordered.select("key", "text").mapInArrow(run, "file string, documents long, ids long"), "id-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the files: file, place (in its file), doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit numbers)."""
    schema = "file string, in_file long, place long, doc_id long, first long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                file, at, out = IdFile(data.as_buffer()), 0, []
                for i in range(len(file)):
                    ids = file.document(i)
                    out.append((file.entry(i)[0], at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                if at != file.total:
                    raise ValueError("a file has another number of ids than it says")
                keys, firsts, counts, sums = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(out), pa.string()), pa.array([len(out)] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64()), pa.array(keys, pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], schema=pa.schema([("file", pa.string()), ("in_file", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    files = stored(spark, folder, "part-*.ids", manifest)
    documents = files.mapInArrow(run, schema)
    # a row for each file, not for each document
    before = manifest.select(F.col("file").alias("__f"), F.col("documents").alias("__n"), F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    checked = documents.join(before, F.col("file") == F.col("__f")).where(F.when(F.col("in_file") == F.col("__n"), True).otherwise(F.raise_error(F.concat(F.lit("an id file is not whole: "), F.col("__f"))).cast("boolean")))
    return checked.withColumn("start", F.col("__base") + F.col("first")).select("file", "place", "doc_id", "start", "n_tokens", "ids_crc32")


def op7(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    manifest = write(docs, folder, tokenizer, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
