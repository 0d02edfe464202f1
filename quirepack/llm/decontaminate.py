"""Benchmark decontamination by multi-pattern search over words (Wu-Manber).

The patterns are the benchmark's 13-word windows (a shorter item is one window).
For each window length a table gives, by the hash of a block of two words, how
far the search may move without passing a window; where it may not move at all,
the full block hash selects the windows that end in this block, and their words
are compared directly. Positions of many stretches of text move in step in numpy.

The benchmark is sent to the executors only in blocks of at most BLOCK_BYTES bytes of
text (some 16 times that as tables, flat arrays), whatever its items' ids and lengths
are: longer items are cut between words. A larger benchmark is searched block by block,
each over all documents.

Nulls: a null text has no words and is not contaminated; benchmark items without
words give no windows; null item ids are named "null". Repeated items with one id
count once. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from .arrowmap import with_columns
from .shared import plain, spent, written
from .textscan import ALNUM_LOWER, Block, blocks, mix, sequence_hashes

WINDOW = 13
BLOCK_BYTES = 4 << 20
STRETCH = 2048
_MULT = np.uint64(0x9E3779B97F4A7C15)


def block_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of words that ends at each place (of one or two words)."""
    if size == 1:
        return mix(words + np.uint64(3))
    out = np.zeros(len(words), np.uint64)
    out[1:] = mix(words[:-1] * _MULT + words[1:])
    return out


class Patterns:
    """A block of benchmark items: their words, joined by single blanks in flat, and where they begin and end there."""

    def __init__(self, texts: list[str | None]) -> None:
        parts, sizes, hashed, counts = [], [], [], []
        for block in blocks(pa.array(texts, pa.large_string()), ALNUM_LOWER):
            words = [block.word(i) for i in range(len(block.starts))]
            parts.extend(words)
            sizes.append(block.ends - block.starts)
            hashed.append(block.hashes())
            counts.append(np.diff(block.bounds))
        none = [np.zeros(0, np.int64)]
        self.flat = b" ".join(parts)
        lengths = np.concatenate(sizes or none)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.hashes = np.concatenate(hashed or [np.zeros(0, np.uint64)])
        self.bounds = np.append(0, np.cumsum(np.concatenate(counts or none)))

    def window(self, first: int, length: int) -> bytes:
        return self.flat[self.starts[first] : self.ends[first + length - 1]]


class Searcher:
    """Shift table, suffix buckets and windows of one length, as flat arrays: about 60 bytes a window."""

    def __init__(self, patterns: Patterns, length: int, items: np.ndarray) -> None:
        """items: those whose windows have this length."""
        self.patterns, self.length, self.block = patterns, length, min(2, length)
        counts = patterns.bounds[items + 1] - patterns.bounds[items] - length + 1
        begin = np.cumsum(counts) - counts
        at = np.repeat(patterns.bounds[items] - begin, counts) + np.arange(counts.sum())
        own = np.repeat(items, counts)
        # equal windows are one, with the items that have them
        _, same = np.unique(sequence_hashes(patterns.hashes, at, length), return_inverse=True)
        pair = np.unique(same * (len(patterns.bounds) + 1) + own)
        which, self.items = pair // (len(patterns.bounds) + 1), (pair % (len(patterns.bounds) + 1)).astype(np.int32)
        self.item_bounds = np.searchsorted(which, np.arange(int(same.max()) + 2))
        first = np.full(int(same.max()) + 1, -1, np.int64)
        first[same[::-1]] = at[::-1]
        bits = max(12, int(16 * len(first)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.far = length - self.block + 1
        self.shift = np.full(1 << bits, self.far, np.int16)
        ends = block_hashes(patterns.hashes, self.block)
        for k in range(self.block - 1, length):  # from far to near, so the least shift stays
            self.shift[(ends[first + k] & self.mask).astype(np.int64)] = length - 1 - k
        suffix = ends[first + length - 1]
        order = np.argsort(suffix, kind="stable")
        self.suffixes, self.windows, self.first = suffix[order], order.astype(np.int32), first.astype(np.int32)

    def candidates(self, block: Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word places where a window may end, by shifting; and the block hashes there."""
        ends = block_hashes(words, self.block)
        firsts, lasts = [], []
        for d in range(block.docs):
            a, b = block.bounds[d] + self.length - 1, block.bounds[d + 1]
            if a < b:
                cuts = np.arange(a, b, STRETCH)
                firsts.append(cuts)
                lasts.append(np.append(cuts[1:], b))
        if not firsts:
            return np.zeros(0, np.int64), ends[:0]
        at, last = np.concatenate(firsts), np.concatenate(lasts)
        slot = (ends & self.mask).astype(np.int64)
        shift = self.shift[slot]
        found = []
        while len(at):
            step = shift[at]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            more = at < last
            at, last = at[more], last[more]
        at = np.concatenate(found)
        place = np.searchsorted(self.suffixes, ends[at])
        place[place == len(self.suffixes)] = 0
        at = np.sort(at[self.suffixes[place] == ends[at]])
        return at, ends[at]

    def occurrences(self, block: Block, words: np.ndarray):
        """(first word, items) of each place where a window stands."""
        at, ends = self.candidates(block, words)
        low, high = np.searchsorted(self.suffixes, ends, "left").tolist(), np.searchsorted(self.suffixes, ends, "right").tolist()
        for i, a, b in zip(at.tolist(), low, high):
            first = i - self.length + 1
            text = b" ".join(block.word(j) for j in range(first, i + 1))
            for w in self.windows[a:b].tolist():
                if self.patterns.window(self.first[w], self.length) == text:
                    yield first, self.items[self.item_bounds[w] : self.item_bounds[w + 1]]
                    break


def searchers(texts: list[str | None], window: int = WINDOW) -> list[Searcher]:
    """Tables for the windows of the given items, by window length; item numbers are places in texts."""
    patterns = Patterns(texts)
    lengths = np.minimum(np.diff(patterns.bounds), window)
    return [Searcher(patterns, int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths) if n]


def packed(rows: Iterable[tuple[str, str]], most: int, window: int) -> Iterator[tuple[list[str], list[str]]]:
    """Ids and texts of blocks of at most so many bytes of text; an item with more is cut between words, with every window whole in some part."""
    ids, texts, size = [], [], 0
    for name, text in rows:
        for part in _parts(text, most, window):
            n = len(part.encode())
            if ids and size + n > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(name)
            texts.append(part)
            size += n
    if ids:
        yield ids, texts


def _parts(text: str, most: int, window: int) -> Iterator[str]:
    if len(text.encode()) <= most:
        yield text
        return
    (block,) = blocks(pa.array([text], pa.large_string()), ALNUM_LOWER)
    n, first = len(block.starts), 0
    while first == 0 or first + window <= n:
        last = max(first + window, int(np.searchsorted(block.ends, block.starts[first] + most, side="right"))) if n else 0
        yield block.raw[block.starts[first] : block.ends[min(last, n) - 1]].tobytes().decode() if n else ""
        if last >= n:
            return
        first = last - window + 1


FIELDS = [StructField("n_words", LongType()), StructField("hit_words", ArrayType(IntegerType())), StructField("hit_items", ArrayType(StringType()))]


def _scan(df: DataFrame, text: str, ids: list[str], tables: list[Searcher], before: bool) -> DataFrame:
    """Adds FIELDS: number of words, places of hit words, ids of occurring items; joined to those found before."""
    tables_of = df.sparkSession.sparkContext.broadcast((ids, tables))
    take = [F.col(c) for c in df.columns if c not in ("n_words", "hit_words", "hit_items")]
    if before:
        df = df.select(*take, F.col("hit_words").alias("__hit"), F.col("hit_items").alias("__items"))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        names, own = tables_of.value
        counts, hits, items = [], [], []
        for block in blocks(batch.column(text), ALNUM_LOWER):
            words = block.hashes()
            hit = np.zeros(len(words) + 1, np.int32)
            found: dict[int, set[int]] = {}
            for table in own:
                for first, which in table.occurrences(block, words):
                    hit[first] += 1
                    hit[first + table.length] -= 1
                    found.setdefault(int(np.searchsorted(block.bounds, first, side="right")) - 1, set()).update(which.tolist())
            covered = np.cumsum(hit[:-1]) > 0
            for d in range(block.docs):
                a, b = block.bounds[d], block.bounds[d + 1]
                counts.append(int(b - a))
                hits.append(np.flatnonzero(covered[a:b]).astype(np.int32))
                items.append(sorted({names[i] for i in found.get(d, ())}))
        if before:
            old_hits, old_items = batch.column("__hit").to_pylist(), batch.column("__items").to_pylist()
            hits = [np.union1d(x, np.asarray(y, np.int32)) for x, y in zip(hits, old_hits)]
            items = [sorted({*x, *y}) for x, y in zip(items, old_items)]
        return [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    out = with_columns(df, FIELDS, compute)
    return out.drop("__hit", "__items")


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with n_words, hit_words (places of words inside any window) and hit_items (sorted ids); columns of these names are replaced."""
    bench = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t"))
    # a partition of the benchmark at a time comes to the driver, a block at a time is kept
    parts = packed(((r["id"], r["t"]) for r in bench.toLocalIterator()), block_bytes, window)
    df, names = plain(df, tuple(f.name for f in FIELDS))
    text = names[text]
    out, kept, n = df, None, 0
    for ids, texts in parts:
        if n:
            table = written(out, "scanned")
            if kept is not None:
                spent(kept)
            out = kept = table
        out = _scan(out, text, ids, searchers(texts, window), before=n > 0)
        n += 1
    out = out if n else _scan(df, text, [], [], before=False)
    return out.select(*names.values(), *(f.name for f in FIELDS)).toDF(*names, *(f.name for f in FIELDS))


def contaminated(n_words="n_words", hits="hit_words"):
    """The rule: some word is hit, and hit words are at least a twentieth of all."""
    n = F.size(hits)
    return (n > 0) & (20 * n >= F.col(n_words))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """df without its contaminated rows."""
    own, names = plain(df)
    return find(own, benchmark, names[text]).where(~contaminated()).select(*names.values()).toDF(*names)


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), benchmark)
    items = F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), items.alias("items_sha256"), contaminated().alias("contaminated"))
