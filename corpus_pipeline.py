"""A corpus in five stages, each one operator over all that the stage before it kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotry.llm import decontaminate, line_dedup, near_dedup, sentencepiece_codec, toxicity
from ballotry.llm.common import model_path, new_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by labels, calls toxic go."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first stays; documents left without text go."""
    left = line_dedup.drop_duplicate_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the smallest doc_id stays."""
    gone = near_dedup.near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their spans in the text, by digest: the training set's index."""
    return sentencepiece_codec.encode(docs, model_path(), ("n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("minhash_near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: SQL has no string-kernel classifier and no BPE; tests check the operators of the stages, and of run() only which rows may be left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
