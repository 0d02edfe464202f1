"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Equal sets are one node. Two nodes are linked when den * |A & B| >= num * |A | B|.

Light side. For sets of sizes a <= b a link needs c(a, b) = ceil(num (a + b) /
(num + den)) common shingles, so two small sets are linked exactly when they have
a common subset of that fixed size. Small sets enumerate these subsets for every
partner size, and equal subsets link their owners without further checks.

Heavy side. Larger sets are found through inverted lists. A list need only hold
a set's first s - ceil(num s / den) + 1 shingles in a global order, rare ones
first: linked sets meet in one of these, and there the shingles that remain in
both must be c(a, b) at least. Lists of two nodes are pairs as they are. Longer
lists are scanned in two rounds, so that no
group emits all its pairs: first every member against up to three hubs of its list, one
of them the member with the fewest rarer shingles of its own, which of a group of
copies is the least changed one; then, with the components of the verified links
known and the hubs done, members outside a list's largest component against those
members that are in another component. Each candidate pair is verified on the whole sets.

Before that, parity bitmaps sort pairs out without the sets: each shingle flips one
bit of its node's bitmap, so two nodes' bitmaps differ in no more bits than their
sets have shingles that only one of them has. Pairs that differ in more than a link
allows are no links; nothing else is left out. A bitmap has a bit or two for each
shingle, so it tells sets of any size apart at a sixty-fourth of their bytes; of two
bitmaps the longer is folded to the shorter. Lists carry bitmaps folded to FOLDED
words; distinct pairs are then held against the whole ones.

In the second round members meet by list and class of sizes: sets that can be linked
are in the same class or in neighbouring ones, so sets of other sizes are never
compared, and a list of a very frequent shingle is dealt out by sizes. Tables that no
later step reads are deleted.

The size at which sets change sides is chosen by cost: what enumeration would emit
against what lists would cost for the sizes that are there (SCAN_COST a posting).
Sets near the boundary are on both sides, so that pairs across it are found.

Order of shingles: the HEAVY_TOKENS most frequent ones come last, by frequency, all
others by hash. Any order that all tasks share gives the same links; this one only
keeps lists short. Frequencies are summed over all documents, per stretch of
STRETCH shingles the ones seen twice or more.

Shingles are 64-bit hashes of word sequences, nodes 128-bit sums of these; lists
carry a node's first 64 bits. No links, components or sets go to the driver.

Nulls and texts without words have empty sets and are linked with nothing. Null
keys are a null component unless a linked row has a key. Repeated rows are equal
sets. Columns of the input other than key and text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .components import components
from .shared import freed, spent, written
from .textscan import SPACED_LOWER, Block, blocks, mix, sequence_hashes

STRETCH = 1_000_000
HEAVY_TOKENS = 1 << 18
SCAN_COST = 16
#: Sets beyond this size are never enumerated, whatever the costs.
LARGEST_LIGHT = 24
#: Bits of the smallest bitmaps, all of which lists carry as FOLDED numbers.
LEAST_BITS = 256
FOLDED = LEAST_BITS // 64
FOLDS = tuple(f"f{i}" for i in range(FOLDED))
#: Nodes whose ids are broadcast to pick out the sets to verify: 256 MB at about 128 bytes a row; beyond, they are joined.
MAX_BROADCAST_NODES = 2_000_000
#: The same for the shingles of lists to scan: 64 MB.
MAX_BROADCAST_LISTS = 500_000
_ONE, _TWO = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, and their bounds."""
    words = block.hashes()
    counts = np.diff(block.bounds)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.append(0, np.cumsum(sizes))
    flat = np.zeros(bounds[-1], np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    is_short = np.zeros(len(flat), bool)
    is_short[bounds[short]] = True
    _, grams = block.grams(words, n)
    flat[~is_short] = grams
    if len(short):
        flat[is_short] = sequence_hashes(words, block.bounds[short], counts[short])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[bounds[:-1][sizes > 0]] = True
    return flat[keep], np.append(0, np.cumsum(keep))[bounds]


def node_ids(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a 128-bit identity of each set; zero for empty ones."""
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    hi, lo = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    if len(some):
        hi[some] = mix(np.add.reduceat(mix(flat + _ONE), bounds[some]) + sizes[some].astype(np.uint64))
        lo[some] = mix(np.add.reduceat(mix(flat ^ _TWO), bounds[some]) + sizes[some].astype(np.uint64))
    return hi.view(np.int64), lo.view(np.int64)


def bitmap_sizes(sizes: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets: the least power of two that is not below the size."""
    bits = np.full(len(sizes), LEAST_BITS, np.int64)
    while (short := bits < sizes).any():
        bits[short] *= 2
    return bits


def _flipped(at: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap in which the bits at the given places are flipped, in bytes."""
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def parities(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets' bitmaps one after the other, their bounds in bytes, and their folds (FOLDED numbers a set)."""
    counts = np.diff(bounds)
    bits = bitmap_sizes(counts)
    ends = np.append(0, np.cumsum(bits))
    places = (flat & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64) + np.repeat(ends[:-1], counts)
    folds = (flat & np.uint64(LEAST_BITS - 1)).astype(np.int64) + np.repeat(np.arange(len(counts)) * LEAST_BITS, counts)
    return _flipped(places, int(ends[-1])), ends // 8, _flipped(folds, len(counts) * LEAST_BITS).view(np.int64).reshape(-1, FOLDED)


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the shorter."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


class Rule:
    """Link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def common(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, s):
        return s - (self.num * s + self.den - 1) // self.den + 1

    def least_partner(self, s: int) -> int:
        return -(-self.num * s // self.den)

    def near_sizes(self, a: Column, b: Column) -> Column:
        return self.den * F.least(a, b) >= self.num * F.greatest(a, b)

    def enough(self, a: Column, i: Column, b: Column, j: Column) -> Column:
        """Whether sets of sizes a and b, met at places i and j, can still have enough in common."""
        return F.least(a - i, b - j) * (self.num + self.den) >= self.num * (a + b)

    def alike(self, what: str) -> Column:
        """Whether the sets of sizes n and {what}_n and with these folded bitmaps can be linked."""
        a, b = F.col("n"), F.col(f"{what}_n")
        first, *rest = (F.bit_count(F.col(w).bitwiseXOR(F.col(f"{what}_{w}"))) for w in FOLDS)
        return self.near_sizes(a, b) & (sum(rest, first) * (self.num + self.den) <= (self.den - self.num) * (a + b))

    def most_apart(self, a: Column, b: Column) -> Column:
        """How many shingles only one of two linked sets of sizes a and b can have. The link's rule says the same."""
        return F.call_function("div", (self.den - self.num) * (a + b), F.lit(self.num + self.den).cast("long"))

    def size_class(self, n: Column) -> Column:
        """Sizes of linked sets are in the same class or in neighbouring ones."""
        if self.num == self.den:
            return n.cast("int")
        # a little wider than the ratio, so that rounding never puts linked sizes further apart
        return F.floor(F.log(n) / (math.log(self.den / self.num) * (1 + 1e-6))).cast("int")


def partner_sizes(rule: Rule, s: int, most: int) -> list[int]:
    return [t for t in range(rule.least_partner(s), min(most, s * rule.den // rule.num) + 1) if rule.common(s, t) <= min(s, t)]


def boundary(rule: Rule, sizes: dict[int, int], scan_cost: float = SCAN_COST) -> int:
    """The largest size on the light side, of least total cost for the given numbers of sets by size."""
    best, at = None, 0
    for x in range(LARGEST_LIGHT + 1):
        light = sum(n * sum(comb(s, rule.common(s, t)) for t in partner_sizes(rule, s, x)) for s, n in sizes.items() if 0 < s <= x)
        heavy = sum(n * scan_cost * rule.prefix(s) for s, n in sizes.items() if s >= rule.least_partner(x + 1) and s > 0)
        if best is None or light + heavy < best:
            best, at = light + heavy, x
    return at


def _heads(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Rows of documents (kind 0: key, hi, lo, n, the parity bitmap and its folds) and of shingles seen more than once in a stretch (kind 1: hi as the shingle, n as its count)."""
    schema = StructType([StructField("kind", IntegerType()), StructField("key", df.schema[key].dataType), StructField("hi", LongType()), StructField("lo", LongType()), StructField("n", LongType()), StructField("bits", BinaryType()), *(StructField(f, LongType()) for f in FOLDS)])

    def often(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        return tokens[counts > 1], counts[counts > 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, kind = 0, None

        def shingle_rows() -> pa.RecordBatch:
            tokens, counts = often(held)
            m = len(tokens)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, kind), pa.array(tokens.view(np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(counts.astype(np.int64)), pa.nulls(m, pa.binary()), *(pa.nulls(m, pa.int64()) for _ in FOLDS)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for block in blocks(batch.column(1), SPACED_LOWER):
                flat, bounds = shingle_sets(block, n)
                hi, lo = node_ids(flat, bounds)
                raw, ends, folds = parities(flat, bounds)
                bits = pa.Array.from_buffers(pa.binary(), block.docs, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(block.docs, np.int32)), batch.column(0).slice(block.first, block.docs), pa.array(hi), pa.array(lo), pa.array(np.diff(bounds)), bits, *(pa.array(np.ascontiguousarray(x)) for x in folds.T)], names=schema.names)
                held.append(flat)
                size += len(flat)
                if size >= STRETCH:
                    yield shingle_rows()
                    held, size = [], 0
        if held:
            yield shingle_rows()
        held.clear()
        freed()

    return df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text")).mapInArrow(run, schema)


class Order:
    """The shared order of shingles: frequent ones last."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def weight(self, flat: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(flat), np.int64)
        place = np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)
        return np.where(self.tokens[place] == flat, self.counts[place], 0)


def _postings(df: DataFrame, text: str, n: int, rule: Rule, order, least: int, most_light: int) -> DataFrame:
    """Rows of lists (token, hi, n, pos) and of subsets of small sets (token, token2, hi, lo; pos null; n is 1 for the smaller, -1 for the larger and 0 for equally large sets)."""
    schema = "token long, token2 long, hi long, lo long, n int, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Order = order.value
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(0), SPACED_LOWER):
                flat, bounds = shingle_sets(block, n)
                hi, lo = node_ids(flat, bounds)
                weight = own.weight(flat)
                tokens, places, nodes, sizes = [], [], [], []
                subsets: list[tuple[int, int, int, int]] = []
                for d, (a, b, h) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), hi.tolist())):
                    s = b - a
                    if not s or h in seen:
                        continue
                    seen.add(h)
                    if s >= least:
                        p = rule.prefix(s)
                        part = flat[a:b]
                        w = weight[a:b]
                        light = part[w == 0][:p]
                        if len(light) < p:  # the shingles are sorted, so the order by weight is stable
                            light = np.append(light, part[np.argsort(w, kind="stable")[len(light) : p]])
                        tokens.append(light)
                        nodes.append(h)
                        sizes.append((s, len(light)))
                    if s <= most_light:
                        one, two = mix(flat[a:b] + _ONE), mix(flat[a:b] ^ _TWO)
                        for t in partner_sizes(rule, s, most_light):
                            mark = np.uint64(min(s, t) << 32 | max(s, t))
                            which = np.array(list(itertools.combinations(range(s), rule.common(s, t))))
                            k1, k2 = (mix(x[which].sum(axis=1, dtype=np.uint64) + mark).view(np.int64) for x in (one, two))
                            side = (s < t) - (s > t)
                            subsets.extend(zip(k1.tolist(), k2.tolist(), itertools.repeat(h), itertools.repeat(int(lo[d])), itertools.repeat(side)))
                if tokens:
                    lengths = np.array([p for _, p in sizes])
                    flat_tokens = np.concatenate(tokens)
                    m = len(flat_tokens)
                    places = np.arange(m) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    yield pa.RecordBatch.from_arrays([pa.array(flat_tokens.view(np.int64)), pa.nulls(m, pa.int64()), pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.nulls(m, pa.int64()), pa.array(np.repeat(np.array([s for s, _ in sizes], np.int32), lengths)), pa.array(places.astype(np.int32))], names=["token", "token2", "hi", "lo", "n", "pos"])
                if subsets:
                    k1, k2, h, low, side = (pa.array(x, pa.int64()) for x in zip(*subsets))
                    m = len(subsets)
                    yield pa.RecordBatch.from_arrays([k1, k2, h, low, side.cast(pa.int32()), pa.nulls(m, pa.int32())], names=["token", "token2", "hi", "lo", "n", "pos"])
        freed()

    return df.select(df[f"`{text}`"].alias("text")).mapInArrow(run, schema)


def _sets(df: DataFrame, text: str, n: int, needed: DataFrame) -> DataFrame:
    """(hi, tokens) of the needed nodes, once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(0), SPACED_LOWER):
                flat, bounds = shingle_sets(block, n)
                hi, _ = node_ids(flat, bounds)
                fresh = []
                for d, h in enumerate(hi.tolist()):
                    if bounds[d] < bounds[d + 1] and h not in seen:
                        seen.add(h)
                        fresh.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(hi[fresh]), pa.array([flat[bounds[d] : bounds[d + 1]].tobytes() for d in fresh], pa.binary())], names=["hi", "tokens"])
        freed()

    every = df.select(df[f"`{text}`"].alias("text")).mapInArrow(run, StructType([StructField("hi", LongType()), StructField("tokens", BinaryType())]))
    return _once(every, "tokens", needed)


def _once(rows: DataFrame, value: str, needed: DataFrame) -> DataFrame:
    """(hi, value) of the needed nodes, once each."""
    few = needed.count() <= MAX_BROADCAST_NODES
    return rows.select("hi", value).join(F.broadcast(needed) if few else needed, "hi", "left_semi").groupBy("hi").agg(F.first(value).alias(value))


def _named(what: str, columns: tuple[str, ...]) -> list[Column]:
    return [F.col(c).alias(f"{what}_{c}") for c in columns]


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return written(pairs.select(F.col("a").alias("hi")).union(pairs.select("b")).distinct(), "nodes")


def _held(pairs: DataFrame, rows: DataFrame, value: str, apart: Callable[[np.ndarray, np.ndarray], int]) -> DataFrame:
    """Those of the pairs (a, b, most) whose nodes' values (hi, value) are not further apart than most."""
    both = pairs.join(rows.select(F.col("hi").alias("a"), F.col(value).alias("x")), "a").join(rows.select(F.col("hi").alias("b"), F.col(value).alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, most = batch.column(3), batch.column(4), batch.column(2).to_pylist()
            keep = [i for i, m in enumerate(most) if apart(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)) <= m]
            yield batch.select(["a", "b", "most"]).take(pa.array(keep, pa.int64()))
        freed()

    return both.select("a", "b", "most", "x", "y").mapInArrow(run, "a long, b long, most long")


def shingles_apart(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles only one of two sorted sets has."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return len(x) + len(y) - 2 * int(np.count_nonzero(y[at] == x))


def _verified(df: DataFrame, text: str, n: int, rule: Rule, pairs: DataFrame, heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes that are links: by sizes and folded bitmaps, by whole bitmaps, and then by the sets."""
    one, other = nodes.select(F.col("hi").alias("a"), "n", *FOLDS), nodes.select(F.col("hi").alias("b"), *_named("b", ("n", *FOLDS)))
    near = written(pairs.join(one, "a").join(other, "b").where(rule.alike("b")).select("a", "b", rule.most_apart(F.col("n"), F.col("b_n")).alias("most")), "near")
    ends = _ends(near)
    alike = written(_held(near, _once(heads.where("kind = 0"), "bits", ends), "bits", bits_apart), "alike")
    needed = _ends(alike)
    links = written(_held(alike, _sets(df, text, n, needed), "tokens", shingles_apart).select("a", "b"), "links")
    spent(near, ends, alike, needed)
    return links


def _light_links(subsets: DataFrame) -> DataFrame:
    """Links of small sets with a common subset: each set with one of the other side (of its own side where sizes are equal)."""
    least = subsets.groupBy("token", "token2").agg(F.min(F.when(F.col("side") >= 0, F.col("hi"))).alias("small"), F.min(F.when(F.col("side") <= 0, F.col("hi"))).alias("large"))
    met = subsets.join(least.where("small is not null and large is not null"), ["token", "token2"])
    other = F.when(F.col("side") > 0, F.col("large")).otherwise(F.col("small"))
    return met.select(other.alias("a"), F.col("hi").alias("b")).where("a <> b").distinct()


def _heavy_links(df: DataFrame, text: str, n: int, rule: Rule, postings: DataFrame, heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of nodes that meet in inverted lists: postings with token, hi, n, pos."""
    lists = postings.where("pos is not null").select("token", "hi", "n", "pos")
    shared = written(lists.groupBy("token").agg(F.min("hi").alias("a"), F.max("hi").alias("b"), F.count(F.lit(1)).alias("k")).where("a <> b"), "shared")
    # while few lists are longer than two, their shingles are broadcast and the others' postings not dealt out again
    long = shared.where("k > 2").select("token", "a", "b")
    few = long.count() <= MAX_BROADCAST_LISTS
    small = F.broadcast if few else lambda df: df
    # dealt by node for the bitmaps, which serves the distinct rows as well
    met = written(lists.join(small(long), "token").join(nodes.select("hi", *FOLDS), "hi").distinct(), "lists")
    spent(postings)
    carried = ("hi", "n", "pos", *FOLDS)

    def near(what: str) -> Column:
        return rule.alike(what) & rule.enough(F.col("n"), F.col("pos"), F.col(f"{what}_n"), F.col(f"{what}_pos"))

    # places first, then nodes, in one number; equal numbers only make more hubs
    place = F.expr("(least(pos, 262143) * 17592186044416L) | shiftrightunsigned(hi, 20)")
    marks = written(met.groupBy("token").agg(F.min(place).alias("hub")), "marks")
    marked = met.join(small(marks), "token").withColumn("is_hub", (place == F.col("hub")) | (F.col("hi") == F.col("a")) | (F.col("hi") == F.col("b")))
    hubs = marked.where("is_hub").select("token", *_named("hub", carried))
    starred = met.join(hubs, "token").where((F.col("hi") != F.col("hub_hi")) & near("hub"))
    twos = shared.where("k = 2").select("a", "b")
    first = written(starred.select(F.least("hi", "hub_hi").alias("a"), F.greatest("hi", "hub_hi").alias("b")).union(twos).distinct(), "pairs")
    links = _verified(df, text, n, rule, first, heads, nodes)
    # hubs were held against all members: only the others are left
    labels = written(components(links), "labels")
    few = labels.count() <= MAX_BROADCAST_NODES
    rest = marked.where("not is_hub").select("token", *carried)
    named = labels.select(F.col("node").alias("hi"), "root")
    labelled = written(rest.join(F.broadcast(named) if few else named, "hi", "left").withColumn("root", F.coalesce("root", "hi")), "labelled")
    spent(shared, met, marks)
    by = labelled.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    several = by.groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", F.col("top.root").alias("top"))
    mixed = written(labelled.join(several, "token").withColumn("sizes", rule.size_class(F.col("n"))), "mixed")
    around = F.explode(F.array(*(F.col("sizes") + d for d in (-1, 0, 1)))).alias("sizes")
    minor = mixed.where("root <> top").select("token", around, F.col("root").alias("x_root"), *_named("x", carried))
    across = (F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("top")) | (F.col("x_hi") < F.col("hi")))
    more = minor.join(mixed, ["token", "sizes"]).where(across & near("x"))
    more = more.select(F.least("x_hi", "hi").alias("a"), F.greatest("x_hi", "hi").alias("b")).distinct()
    more = written(more.join(first, ["a", "b"], "left_anti"), "pairs")
    out = links.union(_verified(df, text, n, rule, more, heads, nodes))
    spent(first, labels, labelled, mixed, more)
    return out


def join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of df: key, n_shingles and component_id, the least key reachable by links."""
    spark, rule = df.sparkSession, Rule(num, den)
    heads = written(_heads(df, key, text, n), "shingle-sets")
    documents = heads.where("kind = 0")
    top = heads.where("kind = 1").groupBy(F.col("hi").alias("token")).agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "token").limit(HEAVY_TOKENS).toPandas()
    order = spark.sparkContext.broadcast(Order(top["token"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)))
    nodes = written(documents.where("n > 0").groupBy("hi", "lo").agg(F.first("n").alias("n"), F.min("key").alias("least"), *(F.first(f).alias(f) for f in FOLDS)), "nodes")
    sizes = {r["n"]: r["c"] for r in nodes.where(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    most_light = boundary(rule, sizes)
    postings = written(_postings(df, text, n, rule, order, rule.least_partner(most_light + 1), most_light), "postings")
    light = written(_light_links(postings.where("pos is null").select("token", "token2", "hi", F.col("n").alias("side"))), "light-links")
    links = _heavy_links(df, text, n, rule, postings, heads, nodes)
    roots = components(links.union(light))
    labelled = nodes.join(roots.select(F.col("node").alias("hi"), "root"), "hi", "left").withColumn("root", F.coalesce("root", "hi"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    label = written(labelled.join(least, "root").select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), "component"), "labels")
    order.destroy()
    spent(nodes, light)
    out = documents.join(label, (F.col("hi") == F.col("__hi")) & (F.col("lo") == F.col("__lo")), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def op1(docs: DataFrame) -> DataFrame:
    return join(docs, "doc_id", "text", 4, 85, 100)
