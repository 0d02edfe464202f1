"""The whole dataflow: inputs to a published archive; and tables of texts as entries."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirepack.functions.names import UTF8_FLAG, archive_name
from quirepack.functions.sizes import hint_bits, task_cost
from quirepack.operators.encode import race
from quirepack.operators.entries import progress_totals, stored_copies
from quirepack.operators.zip_file import Progress, write_archive
from quirepack.plans.policy import Policy, PolicyError, beside_program, parse_arguments
from quirepack.plans.resources import admitted, memory_budget, workers
from quirepack.sources import files
from quirepack.sources.files import SIZE_AT


def policy_dict(policy: Policy) -> dict:
    return {"engines": sorted(policy.engines), "fast_level": policy.fast_level, "zlib_after": policy.zlib_after, "zlib_level": policy.zlib_level}


def text_entries(documents: DataFrame) -> DataFrame:
    """Documents as entries: name source/lang/id.txt, ordinal doc_id, payload the UTF-8 text (null: empty)."""
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    name = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return documents.select(F.col("doc_id").cast("long").alias("ordinal"), name.alias("name"), payload.alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "name_len": F.octet_length("name").cast("int")})


def members(raced: DataFrame, entries: DataFrame, level: int) -> DataFrame:
    """Raced entries with their header fields."""
    head = entries.select(F.col("ordinal").alias("__o"), "raw_name", F.col("flags").alias("__flags"), "mode", "mtime")
    flags = F.col("__flags").bitwiseOR(hint_bits(F.lit(level), F.col("method") == 0))
    return raced.join(head, F.col("ordinal") == F.col("__o")).withColumn("flags", flags).drop("__o", "__flags")


def text_members(documents: DataFrame, policy: Policy, level: int) -> DataFrame:
    """Documents as members ready to be written."""
    raced = race(text_entries(documents), policy_dict(policy))
    flags = F.lit(UTF8_FLAG).bitwiseOR(hint_bits(F.lit(level), F.col("method") == 0))
    return raced.withColumns({"raw_name": F.col("name").cast("binary"), "flags": flags, "mode": F.lit(0o100644).cast("long"), "mtime": F.lit(315_619_200.0)})


def local_workers(spark: SparkSession, found: list[tuple], policy: Policy) -> int | None:
    """Partitions for a run on this machine: as many tasks as its cores and memory take, by the estimated cost of the largest entries; None on a cluster."""
    context = spark.sparkContext
    if not context.master.startswith("local"):
        return None
    budget = memory_budget()
    engines = sorted(policy.engines) or ["zlib"]
    dearest = sorted((max(task_cost(e, size) for e in engines) for size in (row[SIZE_AT] for row in found)), reverse=True)
    return workers(min(context.defaultParallelism, admitted(dearest, budget)), len(found), budget)


def run(spark: SparkSession, arguments: list[str], ini: str | None = None, search: tuple[str, ...] = (), codecs=None, created: str | None = None, show=None) -> tuple[str, int] | str:
    """Runs a command line; returns the archive's path and number of members, or a help text.

    created: where a default INI is put if no INI is found. show: a text stream for progress.
    """
    request = parse_arguments(arguments, ini, search, created)
    if isinstance(request, str):
        return request
    path = archive_name(request.archive)
    found = files.discover(request.inputs, request.policy.recursive, request.literal_from, path)
    entries = files.entries(spark, found, local_workers(spark, found, request.policy))
    # inputs for zlib alone are read a chunk at a time, whole ones only below that size
    alone = F.lit(False) if request.policy.zlib_after is None else F.col("size") >= request.policy.zlib_after
    raced = race(files.with_payload(entries.where(~alone)), policy_dict(request.policy), **({"codecs": codecs} if codecs else {}))
    raced = raced.unionByName(files.deflated(entries.where(alone), request.policy.zlib_level))
    ready = stored_copies(members(raced, entries, request.level))
    total = progress_totals(entries).first()
    return path, write_archive(ready, path, progress=Progress(total["total_work"], total["widest"], show) if show else None)


def main(arguments: list[str] | None = None) -> int:
    try:
        spark = SparkSession.builder.appName("quirepack").getOrCreate()
        done = run(spark, sys.argv[1:] if arguments is None else arguments, os.environ.get("QUIREPACK_INI"), ("quirepack.ini",), created=beside_program("quirepack.ini"), show=sys.stderr)
    except (PolicyError, files.InputError, OSError) as e:
        print(f"quirepack: {e}", file=sys.stderr)
        return 1
    print(done if isinstance(done, str) else f"{done[0]}: {done[1]} members")
    return 0
