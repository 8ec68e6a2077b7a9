"""The corpus pipeline: five stages from raw documents to shards, each on all that the one before it kept.

quality: rows that the discriminant rejects go. near_duplicates: one row of each class of near copies stays. decontamination: rows with a passage of
the benchmark go. mixing: sources are brought to their target weights, rows repeated or left out as the quotas ask. sharding: every row, text included, gets its shard and place
by the latest slot map under spark.tidewatch.slots.path, edited for these rows; without that setting, by a new map that goes when the run ends.

No SQL says the same (fits by covariances, hashed draws, edit distance), so ORACLE_SQL is None. The tests hold what each stage keeps and drops against what
a brute-force version of the stage, on the same input, keeps and drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, read
from tidewatch.llm.decontaminate import without_leaks
from tidewatch.llm.mixing import realise
from tidewatch.llm.ngram_join import one_of_each
from tidewatch.llm.quality import keep_good
from tidewatch.llm.sharding import assign_shards, map_folder

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the discriminant, fitted on the labelled rows of docs, scores below the limit go. A null text counts as empty; repeated rows share their fate; no labels, nothing goes; an empty table stays so."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of the least doc_id stays (null last). Null and empty texts are one class, repeated rows too; texts of any length are compared whole."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a test item stands, within a fifth of its words, go; null and empty texts stay, and all stay where the benchmark is empty."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out as the quotas of their sources ask; rows without words (null and empty texts too) are not taken; null is a source of its own."""
    return realise(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot. Columns of docs that are named as the stage's own (size, text_crc32, law, shard, slot, grown_shard, map_version) are replaced by them."""
    placed = assign_shards(docs, map_path=map_folder(spark, "pipeline"), keep=docs.columns)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet into the shared folder and read again; what a stage leaves behind goes when the next has read it."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, mark = docs, len(Scratch.made)
        docs = scratch.table(stage(spark, before, sf_dir), name)
        Scratch.remove_since(spark, mark)
        if k:
            scratch.drop(before)
    return docs
