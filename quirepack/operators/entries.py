"""Relational steps over entries: dedupe, guards, fan-out, selection, accounting and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirepack.functions.names import display_width, mask_matches, matches_any
from quirepack.functions.sizes import END_BYTES, LOCAL_BYTES, WORK_UNITS, entry_weight, member_bytes, memory_cost

MOST_ENTRIES = 65_535
#: Who wins among equal sizes: the lowest.
PRIORITY = {"turtle": 0, "fast": 1, "ect": 2, "zlib": 3}


def masked(entries: DataFrame, masks: list[str], path: str = "name") -> DataFrame:
    return entries.where(matches_any(F.col(path), masks))


def default_masked(entries: DataFrame, path: str = "name") -> DataFrame:
    """What is taken when nothing is asked for: all but names with a leading dot."""
    return entries.where(mask_matches(F.col(path), "*"))


def keep_first(entries: DataFrame, strict: bool = False) -> DataFrame:
    """The first entry of each name, by ordinal; strict: a repeated name is an error."""
    own = Window.partitionBy("name").orderBy("ordinal")
    ranked = entries.withColumn("__rank", F.row_number().over(own))
    if strict:
        ranked = ranked.where(F.when(F.col("__rank") > 1, F.raise_error(F.concat(F.lit("duplicate entry: "), F.col("name"))).cast("boolean")).otherwise(True))
    return ranked.where("__rank = 1").drop("__rank")


def count_guard(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """One row: the number of entries and whether an archive can hold them. It does not cut any off."""
    return entries.agg(F.count(F.lit(1)).cast("long").alias("entries")).withColumn("fits", F.col("entries") <= most)


def exclude_output(entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """Entries that are not one of the archives being written, by device and inode."""
    return entries.join(outputs.select("dev", "ino").distinct(), ["dev", "ino"], "left_anti")


def fan_out(entries: DataFrame, engines: Column, zlib_after: Column) -> DataFrame:
    """A row for each entry and encoder to try: zlib alone from a size on (null: never), else all enabled ones."""
    alone = F.coalesce(F.col("size") >= zlib_after, F.lit(False))
    return entries.withColumn("zlib_only", alone).withColumn("engine", F.explode(F.when(alone, F.array(F.lit("zlib"))).otherwise(engines)))


def with_costs(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("memory_cost", memory_cost(F.col("engine"), F.col("size")))


def priority(engine: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, p in PRIORITY.items():
        out = F.when(engine == name, p).otherwise(out)
    return out


def smallest(candidates: DataFrame, key: str = "ordinal") -> DataFrame:
    """The smallest candidate of each entry; failed ones (null sizes) never win, and an entry of only failed ones has nulls."""
    best = F.min(F.when(F.col("compressed").isNotNull(), F.struct("compressed", priority(F.col("engine")).alias("p"), "engine")))
    return candidates.groupBy(key).agg(best.alias("b")).select(key, F.col("b.engine").alias("engine"), F.col("b.compressed").alias("compressed"))


def crc_agreement(candidates: DataFrame, key: str = "ordinal") -> DataFrame:
    """Entries with the number of different checksums that their encoders saw, and whether there is only one."""
    return candidates.groupBy(key).agg(F.countDistinct("crc").cast("long").alias("checksums")).withColumn("agree", F.col("checksums") <= 1)


def archive_size(members: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(member_bytes(F.col("name_len"), F.col("compressed"))), F.lit(0))
    return members.agg((total + END_BYTES).cast("long").alias("archive_bytes"), F.count(F.lit(1)).cast("long").alias("members"))


def stored_copies(members: DataFrame) -> DataFrame:
    """members (method, crc, data): a stored copy whose bytes do not have the checksum that the encoders saw makes the run fail."""
    same = (F.col("method") != 0) | (F.crc32("data") == F.col("crc"))
    return members.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("input changed: "), F.col("name"))).cast("boolean")))


def _range_of(value: Column, bounds: list) -> Column:
    """The number of bounds that are not above the value, by halving."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(bounds[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(bounds))


def _prefix_sums(rows: DataFrame, order: str, values: dict[str, Column], parts: int) -> DataFrame:
    """Sums of values over all rows before each, by two levels: sums inside ranges of the order, moved up by the totals of the ranges before.

    The ranges are cut at quantiles, so each has about as many rows, however the order's values lie.
    """
    rows = rows.persist()  # read for the quantiles, the totals and the sums
    bounds = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    ranged = rows.withColumn("__part", _range_of(F.col(order), [int(b) for b in bounds]))
    totals = ranged.groupBy("__part").agg(*(F.sum(v).alias(f"__t_{k}") for k, v in values.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__b_{k}") for k in values))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"__s_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in values.items()})
    out = out.join(F.broadcast(base), F.col("__part") == F.col("__p"))  # one row a range, parts at most
    return out.withColumns({k: (F.col(f"__s_{k}") + F.col(f"__b_{k}")).cast("long") for k in values}).drop("__part", "__p", *(f"__{x}_{k}" for x in "sb" for k in values))


def member_offsets(members: DataFrame, parts: int = 32) -> DataFrame:
    """members with local_offset: where each one's local header starts."""
    own = (F.lit(LOCAL_BYTES) + F.col("name_len").cast("long") + F.col("compressed").cast("long"))
    return _prefix_sums(members, "ordinal", {"local_offset": own}, parts)


def progress(members: DataFrame, parts: int = 32) -> DataFrame:
    """The percentage (in hundredths) shown when each entry is done: work so far by weight, at most 99.99 % until the last."""
    weight = WORK_UNITS * entry_weight(F.col("size"))
    totals = members.agg(F.sum(weight).alias("__total"), F.max("ordinal").alias("__last"))
    before = _prefix_sums(members, "ordinal", {"__before": weight}, parts)
    # whole numbers throughout: work times 10000 does not fit 64 bits for the largest archives
    done = (F.col("__before") + weight).cast("decimal(28,0)") * F.lit(10000).cast("decimal(5,0)")
    exact = F.call_function("div", done, F.col("__total").cast("decimal(28,0)"))
    shown = F.when(F.col("ordinal") == F.col("__last"), exact).otherwise(F.least(exact, F.lit(9999).cast("long")))
    # one row with the totals
    return before.join(F.broadcast(totals), F.lit(True)).withColumn("percent_hundredths", shown.cast("long")).drop("__before", "__total", "__last")


def progress_totals(entries: DataFrame) -> DataFrame:
    """One row: all work units, and the columns of the widest name, to which a display is aligned."""
    work = F.sum(WORK_UNITS * entry_weight(F.col("size")))
    return entries.agg(F.coalesce(work, F.lit(0)).cast("long").alias("total_work"), F.coalesce(F.max(display_width(F.col("name"))), F.lit(0)).cast("long").alias("widest"))


def task_shares(tasks: DataFrame) -> DataFrame:
    """tasks (ordinal, engine, size) with the work units that each adds when it is done: its entry's, divided by the entry's tasks."""
    count = F.count(F.lit(1)).over(Window.partitionBy("ordinal"))
    return tasks.withColumn("share", F.call_function("div", WORK_UNITS * entry_weight(F.col("size")), count))
