"""A training-data pipeline of five operators, each stage over all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirepack.llm import decontaminate, jaccard, pieces, pii, quality
from quirepack.llm.queries import _tokenizer
from quirepack.llm.shared import new_folder, numbered, small_batches, spent, written

#: 16 MB of numbers.
MAX_BROADCAST_ROWS = 2_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "__row"


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (with ROW) but those whose number is in gone: numbers only, broadcast while there are few, joined beyond."""
    few = gone.count() <= MAX_BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, ROW, "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    rows = numbered(docs.select(*COLUMNS), ROW)
    # written without the texts: the fit reads them many times
    statistics = written(quality.with_statistics(rows).drop("doc_id", "text", "n_chars"), "statistics")
    gone = written(quality.judge(statistics, fitted=statistics).where("not kept").select(ROW), "rejected")
    spent(statistics)
    return _without(rows, gone)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that of the least doc_id, null ids last.

    Rows are told apart by their place in the input, so repeated or missing doc_ids do no harm; of rows with the least doc_id the first one stays.
    """
    rows = numbered(docs.select(*COLUMNS), ROW)
    groups = written(jaccard.join(rows.select(ROW, "text"), ROW, "text", 5, 80, 100).select(ROW, "component_id"), "groups")
    # members of groups of one are left out before their ids are looked up
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("component_id")
    members = groups.join(several, "component_id").join(rows.select(ROW, "doc_id"), ROW)
    members = written(members.select(ROW, "component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW).alias("place")), "members")
    first = members.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = written(members.join(first, "component_id").where(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW), "duplicates")
    spent(groups, members)
    return _without(rows, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digests of the ids and of the decoded text."""
    return pieces.encoded(docs, _tokenizer("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("personal data", personal_data), ("piece ids", piece_ids)]
#: The outlier estimates and the merge rounds have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_folder(spark, "pipeline")
            with small_batches(spark):
                docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
