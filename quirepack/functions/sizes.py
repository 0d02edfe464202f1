"""Sizes, hints, costs and ratios, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ZIP format: end record, both headers of a member without its two name copies, local header.
END_BYTES, MEMBER_BYTES, LOCAL_BYTES = 22, 76, 30
MIB = 1 << 20
WORK_UNITS = 6


def level_hint(level: Column) -> Column:
    return F.when(level <= 3, 1).when(level <= 6, 2).when(level <= 8, 6).otherwise(9)


def hint_bits(level: Column, stored: Column) -> Column:
    """General-purpose bits 1 and 2 of a member: how hard it was compressed; none if it is stored."""
    return F.when(stored, 0).otherwise(F.when(level <= 3, 6).when(level <= 6, 4).when(level <= 8, 0).otherwise(2))


def task_cost(engine: str, size: int, block: int = 1_000_000) -> int:
    """memory_cost of one task, for the driver."""
    return {"fast": 3 * size + MIB, "ect": 8 * size + MIB, "turtle": 768 * block + 8 * MIB}.get(engine, 4 * MIB)


def memory_cost(engine: Column, size: Column, block: int = 1_000_000) -> Column:
    """Bytes that a task is estimated to need."""
    return F.when(engine == "fast", 3 * size + MIB).when(engine == "ect", 8 * size + MIB).when(engine == "turtle", F.lit(768 * block + 8 * MIB)).otherwise(F.lit(4 * MIB)).cast("long")


def ratio_hundredths(compressed: Column, size: Column) -> Column:
    """100 times the percentage, rounded half up, in whole numbers; 0 for empty entries."""
    c, n = compressed.cast("long"), size.cast("long")
    return F.when(n == 0, F.lit(0)).otherwise(F.expr("0") + F.floor((c * 10000 + F.floor(n / 2)) / n)).cast("long")


def entry_weight(size: Column) -> Column:
    return F.greatest(size.cast("long"), F.lit(1))


def is_stored(size: Column, compressed: Column, zlib_only: Column) -> Column:
    """Kept as it is: not empty, and no encoder made it smaller. zlib's output is always taken."""
    return ~zlib_only & (size > 0) & (compressed.isNull() | (compressed >= size))


def member_bytes(name_bytes: Column, data_bytes: Column) -> Column:
    return F.lit(MEMBER_BYTES) + 2 * name_bytes.cast("long") + data_bytes.cast("long")
