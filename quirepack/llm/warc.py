"""WARC archives whose records are compressed one by one with a dictionary of their own file.

Each file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary built from the file's first records (TRAIN_BYTES at most, a bounded
sample by design): trained on them, or made of their last bytes where they are too
few to train on. Then it has one zstd frame for each
record, so that a record can be read alone. Of equal payloads (SHA-1 and length)
the row with the largest id is the response and the others are revisits of it.

Nulls: a null payload is empty; null ids are written as "-", count below all
others, and read back as null; a group in which all ids are null has only
responses. Rows repeated with the largest id of their group are all responses.
Files are moved into place whole and read by the manifest that the write returns, so
repeated task attempts, of whatever files, do no harm; a file of the manifest that is
gone or has another number of records is an error. An empty table gives an empty
manifest and no records. Columns other than key, url and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowmap import published, stored, uri
from .dictionaries import dictionary, first_bytes, loaded
from .shared import freed, new_folder, written

SKIPPABLE = 0x184D2A5D
TRAIN_BYTES = 4 << 20
DICT_BYTES = 64 << 10
FILE_BYTES = 24 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    block = HTTP + payload if refers_to is None else HTTP
    name = "-" if page is None else page
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:quirepack:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or 'about:blank').split()) or 'about:blank'}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:quirepack:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def file_parts(records: list[bytes]) -> Iterator[bytes]:
    """A file: the dictionary's frame, then a frame for each record."""
    trained = dictionary(first_bytes(records, TRAIN_BYTES), DICT_BYTES)
    yield struct.pack("<II", SKIPPABLE, len(trained)) + trained
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded(trained))
    for x in records:
        yield packer.compress(x)


def records(data) -> Iterator[bytes]:
    """The records of a file's bytes, in order."""
    view = memoryview(data)
    magic, n = struct.unpack("<II", view[:8])
    if magic != SKIPPABLE:
        raise ValueError("the file has no dictionary frame")
    trained = bytes(view[8 : 8 + n])
    unpacker = zstandard.ZstdDecompressor(dict_data=loaded(trained))
    at = 8 + n
    while at < len(view):
        one, out, step = unpacker.decompressobj(), [], 16 << 10
        while not one.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("a record's frame ends early")
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def with_reference(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """pages with refers_to: the id of the equal payload's response, null for responses. Only payloads that repeat are joined."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    keyed = pages.withColumns({"__sha": F.sha1(data), "__len": F.octet_length(data)})
    groups = keyed.select(F.col("__sha").alias("__s"), F.col("__len").alias("__l"), F.col(key).alias("__k")).groupBy("__s", "__l").agg(F.max("__k").alias("__to"), F.count(F.lit(1)).alias("__n"))
    # its size is known once written: the planner broadcasts it only if it is small
    repeated = written(groups.where("__n > 1 and __to is not null").drop("__n"), "repeated-payloads")
    joined = keyed.join(repeated, (F.col("__sha") == F.col("__s")) & (F.col("__len") == F.col("__l")), "left")
    own = F.col(key).eqNullSafe(F.col("__to"))
    return joined.withColumn("refers_to", F.when(~own, F.col("__to"))).drop("__sha", "__len", "__s", "__l", "__to")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives; returns the manifest (file, records), written already."""
    folder = uri(folder)
    rows = with_reference(pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.col(payload).alias("payload")), "page", "payload").select("page", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names, counts = TaskContext.get().partitionId(), [], []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                names.append(f"part-{part:07d}-{len(names):05d}.warc.zst")
                published(folder, names[-1], file_parts(held))
                counts.append(len(held))
            held, size = [], 0

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                page, address, text, to = (x.as_py() for x in row)
                one = record(page, address, (text or "").encode(), to)
                if size + len(one) > FILE_BYTES:
                    flush()
                held.append(one)
                size += len(one)
        flush()
        freed()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return written(rows.mapInArrow(run, "file string, records long"), "warc-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Records of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Digests of responses are computed from what was read and must agree with their header."""
    names = ["file", "in_file", *(x.split()[0] for x in _COLUMNS.split(", "))]

    def page(name: str | None) -> int | None:
        last = name and name.rstrip(">").rpartition(":")[2]
        return None if last in (None, "-") else int(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                out = []
                for one in records(data.as_buffer()):
                    fields, block = parsed(one)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-payload-length"])
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if sha1_base32(payload) != digest or len(payload) != size:
                            raise ValueError("a payload does not have its digest")
                    out.append((page(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], page(fields.get("warc-refers-to"))))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(out), pa.string()), pa.array([len(out)] * len(out), pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)
        freed()

    files = stored(spark, folder, "part-*.warc.zst", manifest)
    found = files.mapInArrow(run, f"file string, in_file long, {_COLUMNS}")
    # files that a repeated task left behind are not in the manifest
    own = found.join(manifest.select(F.col("file").alias("__f"), F.col("records").alias("__n")), F.col("file") == F.col("__f"))
    checked = own.where(F.when(F.col("in_file") == F.col("__n"), True).otherwise(F.raise_error(F.concat(F.lit("an archive is not whole: "), F.col("__f"))).cast("boolean")))
    return checked.drop("__f", "__n", "file", "in_file")


def op5(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    manifest = write(pages, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], _COLUMNS).drop("url")
    return read(spark, folder, manifest).drop("url")
