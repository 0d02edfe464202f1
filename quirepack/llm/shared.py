"""The shared folder, checkpoints and written tables."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a row group of written tables: the writers of an executor hold one each.
ROW_GROUP = 16 << 20
#: Rows of one file that can be told apart, and files whose numbers are broadcast (about 20 MB).
ROWS_OF_A_FILE = 1 << 38
MAX_BROADCAST_FILES = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one of its own in the warehouse, which they share as well."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quirepack-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    # a path without a scheme is one of Hadoop's default file system, which Python does not know
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    return _file_system(spark, where).makeQualified(where).toString().rstrip("/")


def _file_system(spark: SparkSession, where):
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Arrow batches of fewer rows while a table is written: whole texts and sets make wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that its true size is known to the planner."""
    path = new_folder(df.sparkSession, what)
    with small_batches(df.sparkSession):
        df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_quire_folder"] = path
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads."""
    for table in tables:
        path = table.__dict__.pop("_quire_folder", None)
        if path:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            _file_system(table.sparkSession, where).delete(where, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row that every evaluation gives again, whatever executors are there.

    It is made of the number of the row's file and its place in the file; a table that is
    not a plain read of files is written to the shared folder first.
    """
    place = lambda d: d.withColumns({"__file": F.col("_metadata.file_path"), name: F.col("_metadata.row_index")})
    if "_metadata" not in df._jdf.queryExecution().analyzed().metadataOutput().toString():
        df = written(df, "documents")
    out = place(df)
    # a row for each file, not for each document
    files = written(df.select(F.col("_metadata.file_path").alias("__path")).groupBy("__path").agg(F.count(F.lit(1)).alias("__rows")), "files")
    order = F.row_number().over(Window.orderBy("__path")).cast("long")
    files = files.select("__path", order.alias("__no"))
    few = files.count() <= MAX_BROADCAST_FILES
    out = out.join(F.broadcast(files) if few else files, F.col("__file") == F.col("__path"))
    return out.withColumn(name, F.col("__no") * ROWS_OF_A_FILE + F.col(name)).drop("__file", "__path", "__no")


def plain(df: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under plain names (c0, c1 ...), which clash with no inner name, and the plain name of each; replaced ones are left out."""
    gone = {c.lower() for c in replaced}
    names = [c for c in df.columns if c.lower() not in gone]
    return df.select(*(F.col(f"`{c}`") for c in names)).toDF(*(f"c{i}" for i in range(len(names)))), {c: f"c{i}" for i, c in enumerate(names)}


def freed() -> None:
    """Gives a worker's free memory back to the machine: workers are kept for later tasks, of other operators too."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
