"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a pseudo-random number u in (0, 1) from the key and
the shard's number alone; a row goes to the shard with the least -ln(u) / weight.
A shard so receives rows in proportion to its weight, and adding one moves only
the rows that the new shard wins. Only DataFrame functions are used.

Null keys count as one key of their own and so share a shard; repeated keys go
to the same shard; an empty table gives an empty table. Columns of the input are
read through explicit references and only the named result columns are returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAW = "key"
#: Slots of a shard are numbered in 16 times so many hash buckets.
SLOT_PARTS = 256
#: Fixed values of the hash: the Mersenne prime 2^31 - 1 and the step between shards.
PRIME = 2147483647
STRIDE = 1640531527


def _uniform(first: Column, second: Column, shard: int) -> Column:
    """A number in (0, 1) from two 32-bit halves of the key's hash and the shard's number: two squarings modulo a prime."""
    y = (first + (shard + 1) * STRIDE) % PRIME
    y = (y * y + second) % PRIME
    y = (y * y + first + shard) % PRIME
    return (y + 0.5) / float(PRIME)


def key_halves(key: Column) -> tuple[Column, Column]:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\\N")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME for at in (1, 9))


def rendezvous(first: Column, second: Column, weights: Sequence[float]) -> Column:
    """The number of the shard for a key's hash halves; a shard with weight 0 gets nothing."""
    scores = [F.struct((-F.log(_uniform(first, second, i)) / float(w)).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight")
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(df: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Returns key, size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text plus one, a null text having none. slot: a
    row's place in its shard, gapless from 0, by hash bucket, hash of the key, key,
    checksum and size; rows equal in all of these are told apart arbitrarily.
    Slots are numbered inside hash buckets and moved up by the bucket counts
    before them, so that no task has to hold a whole shard. grown: the weights
    after one more shard, for grown_shard (null without).
    """
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    first, second = key_halves(F.col(key))
    rows = df.select(F.col(key).alias("__key"), text_bytes.alias("__text"), first.alias("__a"), second.alias("__b")).select(
        "__key",
        (F.octet_length("__text") + 1).cast("long").alias("size"),
        F.crc32("__text").cast("long").alias("text_crc32"),
        rendezvous(F.col("__a"), F.col("__b"), weights).alias("shard"),
        (rendezvous(F.col("__a"), F.col("__b"), grown) if grown is not None else F.lit(None).cast("int")).alias("grown_shard"),
        F.col("__a").alias("__hash"),
    ).withColumn("__part", (F.col("__hash") % SLOT_PARTS) * 16 + F.col("text_crc32").bitwiseAND(15))
    counts = rows.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("shard", "__part").orderBy("__hash", F.col("__key").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("__rank", F.row_number().over(inside))
    return numbered.join(base, ["shard", "__part"]).select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("__base") + F.col("__rank") - 1).cast("long").alias("slot"), "grown_shard"
    )
