"""The registered archive queries over the documents table, and their SQL forms for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirepack.functions import names, sizes
from quirepack.operators import encode, entries
from quirepack.plans.archive import policy_dict, text_entries, text_members
from quirepack.plans.policy import catalogue, preset, presets
from quirepack.sources import files

#: A threshold that splits the sample tables; the compiled one is 64 MiB.
THRESHOLD = 8192
ENGINES = ("fast", "ect", "turtle")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_entries(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_E = "SELECT doc_id AS ordinal, source || '/' || lang || '/' || doc_id || '.txt' AS name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, CAST(octet_length(encode(source || '/' || lang || '/' || doc_id || '.txt')) AS INTEGER) AS name_len FROM documents"
#: A stand-in for encoder results in SQL: whole numbers from id and size.
_SIZES = {"fast": (3, 7, 10), "ect": (5, 3, 12), "turtle": (7, 5, 11)}


def _made_size(engine: str, ordinal, size, div):
    a, b, c = _SIZES[engine]
    return div(size * (b + (ordinal * a) % 5), c)


def scan_entries(spark, d):
    return _entries(spark, d).select("ordinal", "name", "name_len", "size", F.lit(names.UTF8_FLAG).alias("flags"))


def mask_basename(spark, d):
    return entries.masked(_entries(spark, d), ["*[0-4].txt"]).select("ordinal", "name")


def mask_path(spark, d):
    return entries.masked(_entries(spark, d), ["src1?/e[ns]/*7.txt"]).select("ordinal", "name")


def mask_any_of(spark, d):
    return entries.masked(_entries(spark, d), ["1*.txt", "src0/de/*"]).select("ordinal", "name")


def _dotted(e: DataFrame) -> DataFrame:
    hidden = F.when(F.col("ordinal") % 7 == 0, F.concat(F.lit("."), F.col("ordinal"))).otherwise(F.col("ordinal").cast("string"))
    return e.withColumn("name", F.concat(F.lit("in/"), hidden, F.lit(".txt")))


def default_mask_hides_dotfiles(spark, d):
    return entries.default_masked(_dotted(_entries(spark, d))).select("ordinal", "name")


def _odd_names(e: DataFrame) -> DataFrame:
    o = F.col("ordinal")
    odd = F.when(o % 6 == 0, F.concat(F.lit("/"), o)).when(o % 6 == 1, F.concat(F.lit("a/../"), o)).when(o % 6 == 2, F.concat(F.lit("a//"), o)).when(o % 6 == 3, F.concat(F.lit("./"), o, F.lit("/"))).when(o % 6 == 4, F.lit("")).otherwise(F.concat(F.lit("a/"), o))
    return e.withColumn("name", odd)


def valid_name(spark, d):
    return _odd_names(_entries(spark, d)).select("ordinal", "name", names.valid_name(F.col("name")).alias("valid"))


def _repeated(e: DataFrame) -> DataFrame:
    return e.withColumn("name", F.concat(F.lit("n"), F.col("size") % 200))


def keep_first_by_name(spark, d):
    return entries.keep_first(_repeated(_entries(spark, d))).select("ordinal", "name")


def entry_count_guard(spark, d):
    return entries.count_guard(_entries(spark, d))


def exclude_output(spark, d):
    e = _entries(spark, d).withColumns({"dev": F.col("ordinal") % 3, "ino": F.col("ordinal") % 50})
    outputs = spark.createDataFrame([(1, 7), (2, 11)], "dev long, ino long")
    return entries.exclude_output(e, outputs).select("ordinal", "dev", "ino")


def zlib_threshold_split(spark, d):
    return _entries(spark, d).select("ordinal", "size", (F.col("size") >= THRESHOLD).alias("zlib_only"))


def _levelled(spark, d):
    own = presets(spark).withColumnRenamed("level", "own_level")
    e = _entries(spark, d).withColumn("level", (F.col("ordinal") % 9 + 1).cast("int"))
    return e.join(F.broadcast(own), F.col("level") == F.col("own_level"))  # nine rows


def preset_lookup(spark, d):
    return _levelled(spark, d).select("ordinal", "level", "fast", "ect", "turtle", "fast_level", "zlib_after", "zlib_level", "ect_iterations")


def engine_fanout(spark, d):
    enabled = F.array_compact(F.array(*(F.when(F.col(e), F.lit(e)) for e in ENGINES)))
    tasks = entries.fan_out(_levelled(spark, d), enabled, F.lit(THRESHOLD))
    return tasks.select("ordinal", "level", "engine", "zlib_only")


def memory_cost(spark, d):
    tasks = entries.fan_out(_entries(spark, d), F.array(*map(F.lit, ENGINES)), F.lit(THRESHOLD))
    return entries.with_costs(tasks).select("ordinal", "engine", "memory_cost")


def level_hint(spark, d):
    level = (F.col("ordinal") % 9 + 1).cast("int")
    return _entries(spark, d).select("ordinal", level.alias("level"), sizes.level_hint(level).alias("hint"), sizes.hint_bits(level, F.col("ordinal") % 4 == 0).alias("bits"))


def _candidates(spark, d):
    e = _entries(spark, d)
    div = lambda a, b: F.floor(a / b).cast("long")
    made = F.array(*(F.struct(F.lit(x).alias("engine"), F.when((F.col("ordinal") + i) % 13 != 0, _made_size(x, F.col("ordinal"), F.col("size"), div)).alias("compressed")) for i, x in enumerate(ENGINES)))
    return e.select("ordinal", "size", "name_len", F.explode(made).alias("c")).select("ordinal", "size", "name_len", "c.*")


def _chosen(spark, d):
    best = entries.smallest(_candidates(spark, d))
    e = _entries(spark, d).select("ordinal", "name", "name_len", "size")
    stored = sizes.is_stored(F.col("size"), F.col("compressed"), F.lit(False))
    return e.join(best, "ordinal").withColumn("stored", stored).withColumn("compressed", F.when(F.col("stored"), F.col("size")).otherwise(F.col("compressed")))


def argmin_candidate(spark, d):
    return entries.smallest(_candidates(spark, d))


def store_decision(spark, d):
    return _chosen(spark, d).select("ordinal", "stored", F.when(F.col("stored"), 0).otherwise(8).alias("method"), "compressed")


def archive_size(spark, d):
    return entries.archive_size(_chosen(spark, d))


def member_offsets(spark, d):
    return entries.member_offsets(_chosen(spark, d)).select("ordinal", "local_offset")


def ratio_hundredths(spark, d):
    return _chosen(spark, d).select("ordinal", sizes.ratio_hundredths(F.col("compressed"), F.col("size")).alias("ratio"))


def progress_percent(spark, d):
    return entries.progress(_entries(spark, d)).select("ordinal", "percent_hundredths")


def scalar_paths(spark, d):
    e = _entries(spark, d)
    dotted = F.concat(F.lit("././"), F.col("name"))
    return e.select("ordinal", names.strip_dot_slash(dotted).alias("stripped"), names.basename(F.col("name")).alias("base"), names.join_path(F.when(F.col("ordinal") % 2 == 0, F.lit(".")).otherwise(F.lit("top")), F.col("name")).alias("joined"), sizes.entry_weight(F.col("size")).alias("weight"))


def _raced(spark, d, level):
    return encode.race(_entries(spark, d), policy_dict(preset(level)), keep_data=False)


def compress_zlib(spark, d):
    return encode.race(_entries(spark, d), policy_dict(preset(6)) | {"zlib_after": 0}, keep_data=False).select("ordinal", "method", "crc", "size", "compressed")


def compress_race(spark, d):
    return _raced(spark, d, 9).select("ordinal", "method", "engine", "crc", "size", "compressed")


def crc_agreement(spark, d):
    """Checksums of what every candidate inflates to, and of the payload: all must be one."""
    raced = encode.race(_entries(spark, d), policy_dict(preset(9)), keep_data=False, strict=False)
    each = raced.select("ordinal", F.explode(F.concat(F.transform("candidates", lambda c: c["crc"]), F.array("crc"))).alias("crc"))
    return entries.crc_agreement(each)


def stored_copy_guard(spark, d):
    copies = _entries(spark, d).select("ordinal", "name", "size", F.lit(0).alias("method"), F.crc32("payload").alias("crc"), F.col("payload").alias("data"))
    return entries.stored_copies(copies).select("ordinal", "size", (F.crc32("data") == F.col("crc")).alias("same"))


#: Bytes of a chunk of the sample tables; the compiled one is 1 MiB.
STEP = 1000


def chunked_read(spark, d):
    """Payloads read a chunk at a time: how many chunks, the last one's length, and whether together they have the payload's checksum."""
    import io
    import zlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for ordinal, payload, crc in zip(*(batch.column(i).to_pylist() for i in range(3))):
                count, last, seen = 0, 0, 0
                for piece in files.chunks(io.BytesIO(payload), len(payload), ordinal, STEP):
                    count, last, seen = count + 1, len(piece), zlib.crc32(piece, seen)
                rows.append((ordinal, count, last, seen == crc))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["ordinal", "chunks", "last_bytes", "same"])

    return _entries(spark, d).select("ordinal", "payload", F.crc32("payload").alias("crc")).mapInArrow(run, "ordinal long, chunks long, last_bytes long, same boolean")


def admissible_names(spark, d):
    e = _odd_names(_entries(spark, d))
    return e.select("ordinal", names.admissible(F.col("name"), F.col("size")).alias("admissible"), names.name_flags(F.col("name").cast("binary")).alias("flags"))


def display_width(spark, d):
    e = _entries(spark, d).withColumn("name", F.concat(F.lit("\u65e5\u672ce\u0301"), F.col("ordinal").cast("string")))
    return e.select("ordinal", names.display_width(F.col("name")).cast("long").alias("width"))


def progress_totals(spark, d):
    return entries.progress_totals(_entries(spark, d))


def task_shares(spark, d):
    tasks = entries.fan_out(_entries(spark, d), F.array(*map(F.lit, ENGINES)), F.lit(THRESHOLD))
    return entries.task_shares(tasks).select("ordinal", "engine", "share")


def settings(spark, d):
    """Encoder settings and their bounds that hold for all levels."""
    return catalogue(spark).where("setting in ('--libdeflate_level', '--zlib_level')").select("setting", "least", "greatest")


def archive_roundtrip(spark, d):
    """Members at level 6 and whether their bytes inflate to their payload again: one row each."""
    import zlib

    import pyarrow as pa

    ready = text_members(spark.read.parquet(f"{d}/documents.parquet"), preset(6), 6)

    def run(batches):
        for batch in batches:
            ok = [zlib.crc32(x.as_py() if m.as_py() == 0 else zlib.decompress(x.as_py(), -15)) == c.as_py() for m, c, x in zip(*(batch.column(n) for n in ("method", "crc", "data")))]
            yield pa.RecordBatch.from_arrays([batch.column("ordinal"), pa.array(ok, pa.bool_())], names=["ordinal", "same"])

    return ready.select("ordinal", "method", "crc", "data").mapInArrow(run, "ordinal long, same boolean")


def level6_report(spark, d):
    """Per document at level 6: method, checksum, sizes and ratio."""
    r = _raced(spark, d, 6)
    return r.select("ordinal", "name", "method", "crc", "size", "compressed", sizes.ratio_hundredths(F.col("compressed"), F.col("size")).alias("ratio"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (scan_entries, mask_basename, mask_path, mask_any_of, default_mask_hides_dotfiles, valid_name, keep_first_by_name, entry_count_guard, exclude_output, zlib_threshold_split, preset_lookup, engine_fanout, memory_cost, level_hint, argmin_candidate, store_decision, crc_agreement, archive_size, member_offsets, ratio_hundredths, progress_percent, scalar_paths, compress_zlib, compress_race, archive_roundtrip, level6_report, stored_copy_guard, chunked_read, admissible_names, display_width, progress_totals, task_shares, settings)
}


def oracle_sql() -> dict[str, str]:
    with_e = f"WITH e AS ({_E})"
    rows = []
    for level in range(1, 10):
        p = preset(level)
        null = lambda x: "NULL" if x is None else str(x)
        rows.append(f"({level}, {'fast' in p.engines}, {'ect' in p.engines}, {'turtle' in p.engines}, {p.fast_level if 'fast' in p.engines else 'NULL'}, {null(p.zlib_after)}, {p.zlib_level}, {dict(p.ect)['numiterations'] if 'ect' in p.engines else 'NULL'})")
    table = f"p(level, fast, ect, turtle, fast_level, zlib_after, zlib_level, ect_iterations) AS (SELECT CAST(a AS INTEGER), b, c, d, CAST(f AS INTEGER), CAST(g AS BIGINT), CAST(h AS INTEGER), CAST(i AS INTEGER) FROM (VALUES {', '.join(rows)}) AS v(a, b, c, d, f, g, h, i))"
    levelled = f"{with_e}, {table}, l AS (SELECT e.*, p.* FROM e JOIN p ON p.level = e.ordinal % 9 + 1)"
    div = lambda a, b: f"({a}) // {b}"
    made = " UNION ALL ".join(f"SELECT ordinal, size, name_len, '{x}' AS engine, {entries.PRIORITY[x]} AS pr, CASE WHEN (ordinal + {i}) % 13 <> 0 THEN {_made_size_sql(x, div)} END AS compressed FROM e" for i, x in enumerate(ENGINES))
    best = f"{with_e}, c AS ({made}), r AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY compressed NULLS LAST, pr) AS k FROM c), b AS (SELECT ordinal, CASE WHEN compressed IS NOT NULL THEN engine END AS engine, CAST(compressed AS BIGINT) AS compressed FROM r WHERE k = 1)"
    chosen = f"{best}, h AS (SELECT e.ordinal, e.name_len, e.size, size > 0 AND (compressed IS NULL OR compressed >= size) AS stored, CASE WHEN size > 0 AND (compressed IS NULL OR compressed >= size) THEN size ELSE compressed END AS compressed FROM e JOIN b USING (ordinal))"
    tasks = f"t AS (SELECT ordinal, size, unnest(CASE WHEN size >= {THRESHOLD} THEN ['zlib'] ELSE ['fast', 'ect', 'turtle'] END) AS engine FROM e)"
    o = "CAST(doc_id AS VARCHAR)"
    return {
        "scan_entries": f"{with_e} SELECT ordinal, name, name_len, size, {names.UTF8_FLAG} AS flags FROM e",
        "mask_basename": f"{with_e} SELECT ordinal, name FROM e WHERE regexp_matches(name, '/([^./][^/]*)?[0-4]\\.txt$')",
        "mask_path": f"{with_e} SELECT ordinal, name FROM e WHERE regexp_full_match(name, 'src1[^/]/e[ns]/([^./][^/]*)?7\\.txt')",
        "mask_any_of": f"{with_e} SELECT ordinal, name FROM e WHERE regexp_matches(name, '/1[^/]*\\.txt$') OR regexp_full_match(name, 'src0/de/([^./][^/]*)?')",
        "default_mask_hides_dotfiles": f"SELECT doc_id AS ordinal, 'in/' || {o} || '.txt' AS name FROM documents WHERE doc_id % 7 <> 0",
        "valid_name": f"SELECT doc_id AS ordinal, CASE doc_id % 6 WHEN 0 THEN '/' || {o} WHEN 1 THEN 'a/../' || {o} WHEN 2 THEN 'a//' || {o} WHEN 3 THEN './' || {o} || '/' WHEN 4 THEN '' ELSE 'a/' || {o} END AS name, doc_id % 6 IN (3, 5) AS valid FROM documents",
        "keep_first_by_name": f"{with_e} SELECT min(ordinal) AS ordinal, 'n' || (size % 200) AS name FROM e GROUP BY size % 200",
        "entry_count_guard": "SELECT count(*) AS entries, count(*) <= 65535 AS fits FROM documents",
        "exclude_output": "SELECT doc_id AS ordinal, doc_id % 3 AS dev, doc_id % 50 AS ino FROM documents WHERE NOT (doc_id % 3 = 1 AND doc_id % 50 = 7) AND NOT (doc_id % 3 = 2 AND doc_id % 50 = 11)",
        "zlib_threshold_split": f"{with_e} SELECT ordinal, size, size >= {THRESHOLD} AS zlib_only FROM e",
        "preset_lookup": f"{levelled} SELECT ordinal, level, fast, ect, turtle, fast_level, zlib_after, zlib_level, ect_iterations FROM l",
        "engine_fanout": f"{levelled} SELECT ordinal, level, unnest(CASE WHEN size >= {THRESHOLD} THEN ['zlib'] ELSE list_filter([CASE WHEN fast THEN 'fast' END, CASE WHEN ect THEN 'ect' END, CASE WHEN turtle THEN 'turtle' END], lambda x: x IS NOT NULL) END) AS engine, size >= {THRESHOLD} AS zlib_only FROM l",
        "memory_cost": f"{with_e}, {tasks} SELECT ordinal, engine, CAST(CASE engine WHEN 'fast' THEN 3 * size + 1048576 WHEN 'ect' THEN 8 * size + 1048576 WHEN 'turtle' THEN 768 * 1000000 + 8 * 1048576 ELSE 4 * 1048576 END AS BIGINT) AS memory_cost FROM t",
        "level_hint": "SELECT doc_id AS ordinal, CAST(doc_id % 9 + 1 AS INTEGER) AS level, CASE WHEN doc_id % 9 < 3 THEN 1 WHEN doc_id % 9 < 6 THEN 2 WHEN doc_id % 9 < 8 THEN 6 ELSE 9 END AS hint, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 9 < 3 THEN 6 WHEN doc_id % 9 < 6 THEN 4 WHEN doc_id % 9 < 8 THEN 0 ELSE 2 END AS bits FROM documents",
        "argmin_candidate": f"{best} SELECT ordinal, engine, compressed FROM b",
        "store_decision": f"{chosen} SELECT ordinal, stored, CASE WHEN stored THEN 0 ELSE 8 END AS method, compressed FROM h",
        "archive_size": f"{chosen} SELECT CAST(22 + sum(76 + 2 * name_len + compressed) AS BIGINT) AS archive_bytes, count(*) AS members FROM h",
        "member_offsets": f"{chosen} SELECT ordinal, CAST(coalesce(sum(30 + name_len + compressed) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS local_offset FROM h",
        "ratio_hundredths": f"{chosen} SELECT ordinal, CAST(CASE WHEN size = 0 THEN 0 ELSE (compressed * 10000 + size // 2) // size END AS BIGINT) AS ratio FROM h",
        "progress_percent": f"{with_e}, w AS (SELECT ordinal, CAST(sum(6 * greatest(size, 1)) OVER (ORDER BY ordinal) AS BIGINT) AS done, CAST(sum(6 * greatest(size, 1)) OVER () AS BIGINT) AS total, max(ordinal) OVER () AS last FROM e) SELECT ordinal, CASE WHEN ordinal = last THEN done * 10000 // total ELSE least(done * 10000 // total, 9999) END AS percent_hundredths FROM w",
        "crc_agreement": "SELECT doc_id AS ordinal, CAST(1 AS BIGINT) AS checksums, true AS agree FROM documents",
        "stored_copy_guard": f"{with_e} SELECT ordinal, size, true AS same FROM e",
        "chunked_read": f"{with_e} SELECT ordinal, (size + {STEP - 1}) // {STEP} AS chunks, CASE WHEN size = 0 THEN 0 ELSE (size - 1) % {STEP} + 1 END AS last_bytes, true AS same FROM e",
        "admissible_names": f"{with_e} SELECT ordinal, ordinal % 6 IN (3, 5) AND size <= 4294967295 AS admissible, {names.UTF8_FLAG} AS flags FROM e",
        "display_width": f"SELECT doc_id AS ordinal, CAST(5 + length({o}) AS BIGINT) AS width FROM documents",
        "progress_totals": f"{with_e} SELECT CAST(sum(6 * greatest(size, 1)) AS BIGINT) AS total_work, CAST(max(length(name)) AS BIGINT) AS widest FROM e",
        "task_shares": f"{with_e}, {tasks} SELECT ordinal, engine, CAST(6 * greatest(size, 1) // CASE WHEN size >= {THRESHOLD} THEN 1 ELSE 3 END AS BIGINT) AS share FROM t",
        "settings": "SELECT * FROM (VALUES ('--libdeflate_level', 1, 12), ('--zlib_level', 1, 9)) AS s(setting, least, greatest)",
        "archive_roundtrip": "SELECT doc_id AS ordinal, true AS same FROM documents",
        "scalar_paths": f"{with_e} SELECT ordinal, name AS stripped, string_split(name, '/')[-1] AS base, CASE WHEN ordinal % 2 = 0 THEN name ELSE 'top/' || name END AS joined, greatest(size, 1) AS weight FROM e",
    }


def _made_size_sql(engine: str, div) -> str:
    a, b, c = _SIZES[engine]
    return div(f"size * ({b} + (ordinal * {a}) % 5)", c)
