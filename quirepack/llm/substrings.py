"""Substring dedup by relative Lempel-Ziv parsing.

A word is removed when a window of WINDOW consecutive words around it also starts
somewhere else, in the same document or another. The corpus is its own reference,
dealt into blocks so that every document is factored against each block that can
hold a copy of one of its windows, and no other:

1. Each window has an anchor, the least hash among its ANCHOR-word sequences
   (leftmost if several). Equal windows have equal anchors at equal places, so
   windows whose anchor stands only once in the corpus have no copy.
2. The other windows go to the block of their route, as runs of consecutive windows
   around one place. The route is the anchor; where more than MOST_RUNS runs have it,
   it is the anchor and the greatest hash of the window as well; and where these are
   too many again, the window's whole content, whose block is one window and its
   copies. Windows that are equal have equal routes at each of these levels, and
   routes that stand once have no copy. So no block grows with the input.
3. A block's runs are its reference. It is indexed by a suffix array over the runs:
   window starts sorted by the windows that follow, so that the longest match of any
   place is with a neighbour. Each run is parsed greedily: the longest match from a
   place is a factor if it has WINDOW words or more, the next factor starts behind
   it, and where nothing matches the parse goes on one word later. Windows over a
   factor's end are looked up by themselves, each one that is found being a factor.
   All factors are duplicate spans.

Blocks are streamed through a task, MOST_RUNS runs or one route at a time. Windows
are compared by 64-bit hashes besides the 64-bit hash of their route.

Nulls and empty texts have no words. Texts shorter than a window lose nothing.
Repeated rows are copies of each other and lose all windows, as do all copies.
Rows are told apart by an internal key, so null or repeated doc_ids do no harm, and
columns of any name stay but n_words, n_removed and kept, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .arrowmap import with_columns
from .shared import freed, numbered, plain, spent, written
from .textscan import SPACED, Block, blocks, buffers, mix, sequence_hashes

WINDOW = 35
ANCHOR = 10
#: Runs of a block, of about 150 bytes each: 2 MB, and some 15 MB while it is indexed.
MOST_RUNS = 16_384
KEY = "__row"
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding_least(low: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each span of values, and the leftmost place of it."""
    where, width = np.arange(len(low)), 1
    while 2 * width <= span:
        later = low[width:] < low[:-width]
        where = np.where(later, where[width:], where[:-width])
        low = np.where(later, low[width:], low[:-width])
        width *= 2
    if width < span:
        gap = span - width
        later = low[gap:] < low[:-gap]
        where = np.where(later, where[gap:], where[:-gap])
        low = np.where(later, low[gap:], low[:-gap])
    return low, where


def windows(block: Block, window: int = WINDOW, anchor: int = ANCHOR, greatest: bool = False):
    """(starts, hashes of anchors, places of anchors, word hashes) of all windows in the block, as word numbers; greatest: by the greatest hash."""
    words = block.hashes()
    n = len(words)
    at, grams = block.grams(words, anchor)
    low = np.full(n + window, _TOP, np.uint64)
    low[at] = ~grams if greatest else grams
    low, where = _sliding_least(low, window - anchor + 1)
    room = np.repeat(block.bounds[1:], np.diff(block.bounds)) - np.arange(n)
    starts = np.flatnonzero(room >= window)
    return starts, low[starts], where[starts], words


def _anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, key, pos): each anchor of each document, pos in words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for block in blocks(batch.column(1), SPACED):
                _, hashes, places, _ = windows(block, window, anchor)
                if len(places):
                    fresh = np.append(True, places[1:] != places[:-1])
                    hashes, places = hashes[fresh], places[fresh]
                    doc = np.searchsorted(block.bounds, places, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys[block.first + doc]), pa.array((places - block.bounds[doc]).astype(np.int32))], names=["anchor", "key", "pos"])

    return rows.mapInArrow(run, "anchor long, key long, pos int")


def _runs(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """From (key, text, places: twice the word number of repeated anchors, plus one if they have too many runs): (level, route, key, start, hashes) of runs of windows around an anchor (level 1) or around an anchor and a greatest hash (level 2)."""
    names = ["level", "route", "key", "start", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places_of = batch.column(0).to_numpy(), batch.column(2)
            for block in blocks(batch.column(1), SPACED):
                starts, hashes, places, words = windows(block, window, anchor)
                if not len(starts):
                    continue
                lists = places_of.slice(block.first, block.docs)
                own = lists.flatten().to_numpy()
                doc_of = np.repeat(np.arange(block.docs), lists.value_lengths().fill_null(0).to_numpy())
                state = np.zeros(len(words), np.int8)
                state[block.bounds[doc_of] + (own >> 1)] = 1 + (own & 1)
                level = state[places]
                some = np.flatnonzero(level)
                if not len(some):
                    continue
                second = places
                if (level == 2).any():
                    _, more, second, _ = windows(block, window, anchor, greatest=True)
                    hashes = np.where(level == 2, mix(hashes ^ mix(more)), hashes)
                    second = np.where(level == 2, second, places)
                starts, hashes, places, second, level = starts[some], hashes[some], places[some], second[some], level[some]
                full = sequence_hashes(words, starts, window)
                doc = np.searchsorted(block.bounds, starts, side="right") - 1
                fresh = np.append(True, (places[1:] != places[:-1]) | (second[1:] != second[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1]))
                first = np.flatnonzero(fresh)
                offsets = np.append(first, len(starts)).astype(np.int32) * 8
                data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(full))])
                local = (starts[first] - block.bounds[doc[first]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(level[first].astype(np.int32)), pa.array(hashes[first].view(np.int64)), pa.array(keys[block.first + doc[first]]), pa.array(local), data], names=names)
        freed()

    return rows.mapInArrow(run, "level int, route long, key long, start int, hashes binary")


class Reference:
    """A block's index: a suffix array over its windows, which lie run after run. Suffixes end with their run."""

    def __init__(self, route: np.ndarray, run_of: np.ndarray, hashes: np.ndarray) -> None:
        """One entry a window: its run's route, its run, and its hash."""
        n = len(hashes)
        self.left = np.zeros(n, np.int64)  # windows from here to the run's end
        if n:
            ends = np.append(np.flatnonzero(run_of[1:] != run_of[:-1]) + 1, n)
            self.left = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n)
        _, rank = np.unique(mix(hashes ^ mix(route + np.uint64(5))), return_inverse=True)
        self.ranks, width = [rank], 1
        while (self.left > width).any():
            # the rank of twice as many windows, from the ranks of both halves; a run's end comes before all
            rest = np.zeros(n, np.int64)
            on = np.flatnonzero(self.left > width)
            rest[on] = rank[on + width] + 1
            _, rank = np.unique(rank * (n + 1) + rest, return_inverse=True)
            self.ranks.append(rank)
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        between = self.common(self.order[:-1], self.order[1:]) if n else np.zeros(0, np.int64)
        before, after = np.append(0, between), np.append(between, 0)
        neighbour = np.where(after > before, np.append(self.order[1:], -1) if n else self.order, np.append(-1, self.order[:-1]) if n else self.order)
        self.longest, self.match = np.empty(n, np.int64), np.empty(n, np.int64)
        self.longest[self.order], self.match[self.order] = np.maximum(before, after), neighbour

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many windows from x on follow from y on as well, inside their runs."""
        x, y = x.copy(), y.copy()
        most = np.minimum(self.left[x], self.left[y])
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            width = 1 << k
            # a rank compares whole spans only where both have that many windows left
            can = np.flatnonzero(most - out >= width)
            same = can[self.ranks[k][x[can] + out[can]] == self.ranks[k][y[can] + out[can]]]
            out[same] += width
        return out


def parsed(reference: Reference, first: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The factors of all runs (first window and number of windows of each): first window, number of windows, and the window that matches the first one.

    All runs are parsed in step. A match of m windows has m + window - 1 words.
    """
    starts, lengths = [], []
    at, end = first.copy(), first + count
    while len(at):
        found = reference.longest[at]
        hit = np.flatnonzero(found)
        starts.append(at[hit])
        lengths.append(found[hit])
        # windows that begin in a factor and end behind it
        behind = np.minimum(at[hit] + found[hit] + window - 1, end[hit])
        edge = behind - (at[hit] + found[hit])
        over = np.repeat(at[hit] + found[hit] - (np.cumsum(edge) - edge), edge) + np.arange(edge.sum())
        over = over[reference.longest[over] > 0]
        starts.append(over)
        lengths.append(np.ones(len(over), np.int64))
        at = np.where(found > 0, at + found + window - 1, at + 1)
        more = at < end
        at, end = at[more], end[more]
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return where, (np.concatenate(lengths) if lengths else where), reference.match[where]


def _window_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs' windows one after the other, and how many each run has."""
    data, offsets = buffers(column)
    return np.ascontiguousarray(data[offsets[0] : offsets[-1]]).view(np.uint64), np.diff(offsets) // 8


def _block_factors(block: pa.Table, window: int) -> pa.RecordBatch:
    route, key, start = (block.column(c).to_numpy() for c in ("route", "key", "start"))
    hashes, lengths = _window_hashes(block.column("hashes"))
    run_of = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    where, count, match = parsed(Reference(route.view(np.uint64)[run_of], run_of, hashes), first, lengths, window)
    at = lambda w: (pa.array(key[run_of[w]]), pa.array((start[run_of[w]] + w - first[run_of[w]]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*at(where), pa.array((count + window - 1).astype(np.int32)), *at(match)], names=["key", "start", "length", "ref_key", "ref_start"])


def _parse(runs: DataFrame, window: int) -> DataFrame:
    """Factors of all runs against their blocks: (key, start, length in words, ref_key, ref_start). No route may have more than MOST_RUNS runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += len(table)
            if size < MOST_RUNS:
                continue
            # the last route may go on in the next batch
            whole = pa.concat_tables(held)
            route = whole.column("route").to_numpy()
            done = int(np.searchsorted(route, route[-1], side="left"))
            if done:
                yield _block_factors(whole.slice(0, done), window)
            held, size = [whole.slice(done)], len(whole) - done
        if size:
            yield _block_factors(pa.concat_tables(held), window)
        held.clear()
        freed()

    dealt = runs.select("route", "key", "start", "hashes").repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(run, "key long, start int, length int, ref_key long, ref_start int")


def _single_windows(runs: DataFrame) -> DataFrame:
    """(route: the window's content, key, start) of every window of the runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, start, route, raw = (batch.column(c) for c in ("key", "start", "route", "hashes"))
            hashes, lengths = _window_hashes(raw)
            inside = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            own = mix(hashes ^ mix(np.repeat(route.to_numpy().view(np.uint64), lengths)))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.repeat(key.to_numpy(), lengths)), pa.array((np.repeat(start.to_numpy(), lengths) + inside).astype(np.int32))], names=["route", "key", "start"])

    return runs.select("route", "key", "start", "hashes").mapInArrow(run, "route long, key long, start int")


def duplicate_spans(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_runs: int = MOST_RUNS) -> DataFrame:
    """(key, spans: starts and ends in words, overlapping) of rows (key, text), for keys with any. rows are read more than once and must have stable keys."""
    several = lambda df, column: df.groupBy(column).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    anchors = written(_anchors(rows, window, anchor), "anchors")
    # written, so that a frequent anchor's rows can be split where the two are joined
    repeated = written(several(anchors, "anchor"), "repeated")
    place = (2 * F.col("pos") + (F.col("k") > most_runs).cast("int")).alias("place")
    places = written(anchors.join(repeated, "anchor").select("key", place).groupBy("key").agg(F.collect_list("place").alias("places")), "places")
    own = places.withColumnRenamed("key", "__key")
    met = rows.join(own, F.col("key") == F.col("__key")).select("key", "text", "places")
    runs = written(_runs(met, window, anchor), "runs")
    spent(anchors, repeated, places)
    factors = _parse(runs.where("level = 1"), window).select("key", "start", (F.col("start") + F.col("length")).alias("end"))
    finer = runs.where("level = 2").drop("level")
    left = [runs]
    if not finer.isEmpty():
        sizes = written(several(finer, "route").withColumnRenamed("route", "__route"), "routes")
        dealt = lambda rule: finer.join(sizes.where(rule), F.col("route") == F.col("__route")).drop("__route", "k")
        second = _parse(dealt(f"k <= {most_runs}"), window).select("key", "start", (F.col("start") + F.col("length")).alias("end"))
        # a block of one window's copies needs no index: each is a factor of one window
        alike = written(_single_windows(dealt(f"k > {most_runs}")), "windows")
        copied = written(several(alike, "route").select(F.col("route").alias("__route")), "copied")
        third = alike.join(copied, F.col("route") == F.col("__route")).select("key", "start", (F.col("start") + window).alias("end"))
        factors = factors.union(second).union(third)
        left += [sizes, alike, copied]
    out = written(factors.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    spent(*left)
    return out


def _covered(batch: pa.RecordBatch, block: Block, spans: str) -> np.ndarray:
    """Which of the block's words lie in a span of their document."""
    lists = batch.column(spans).slice(block.first, block.docs)
    flat = lists.flatten()
    doc = np.repeat(np.arange(block.docs), lists.value_lengths().fill_null(0).to_numpy())
    change = np.zeros(len(block.starts) + 1, np.int64)
    if len(flat):
        np.add.at(change, block.bounds[doc] + flat.field("start").to_numpy(), 1)
        np.add.at(change, block.bounds[doc] + flat.field("end").to_numpy(), -1)
    return np.cumsum(change[:-1]) > 0


def with_kept(df: DataFrame, text: str = "text", window: int = WINDOW, most_runs: int = MOST_RUNS) -> DataFrame:
    """df with n_words, n_removed and kept (the words left, joined by one blank); columns of these names are replaced, all others stay."""
    df, names = plain(df, ("n_words", "n_removed", "kept"))
    text = names[text]
    keyed = numbered(df, KEY)
    spans = duplicate_spans(keyed.select(F.col(KEY).alias("key"), F.col(text).alias("text")), window, most_runs=most_runs)
    rows = keyed.join(spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), F.col(KEY) == F.col("__key"), "left").drop("__key")
    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, removed, kept = [], [], []
        for block in blocks(batch.column(text), SPACED):
            gone = _covered(batch, block, "__spans")
            total = np.append(0, np.cumsum(gone))
            counts.extend(np.diff(block.bounds).tolist())
            removed.extend(np.diff(total[block.bounds]).tolist())
            raw, starts, ends = memoryview(block.raw), block.starts.tolist(), block.ends.tolist()
            stay = ~gone
            for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
                kept.append(b" ".join([raw[starts[i] : ends[i]] for i in (np.flatnonzero(stay[a:b]) + a).tolist()]).decode())
        return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

    return with_columns(rows, fields, compute).drop(KEY, "__spans").toDF(*names, "n_words", "n_removed", "kept")


def op4(docs: DataFrame) -> DataFrame:
    kept = with_kept(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

