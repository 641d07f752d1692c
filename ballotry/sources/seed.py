"""Seed opinions from a JSON document of tags, opinions and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tags array<struct<id string, label string, description string>>, opinions array<struct<id string, tagId string, text string, kind string, sourceIds array<string>>>, sources array<struct<id string, title string, url string, note string>>"


def read_seed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three lists as DataFrames."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    lists = {n: doc.select(F.explode(n).alias("r")).select("r.*") for n in ("tags", "opinions", "sources")}
    lists["opinions"] = lists["opinions"].withColumnsRenamed({"tagId": "tag_id", "sourceIds": "source_ids"})
    return lists


def missing(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed opinions that aren't stored yet."""
    return seed.join(stored.select("id"), "id", "left_anti")


def check_fixture(votes: DataFrame, opinions: DataFrame) -> DataFrame:
    """One row: do a fixture's votes use exactly the known opinions, known values and no pair twice."""
    known, used = opinions.select(F.col("id").alias("opinion_id")).distinct(), votes.select("opinion_id").distinct()
    n = lambda d, name: d.agg((F.count("*") == 0).alias(name))
    same = n(used.join(known, "opinion_id", "left_anti").union(known.join(used, "opinion_id", "left_anti")), "same_opinions")
    values = votes.agg((F.count_if(~F.coalesce(F.col("value").isin(-1, 0, 1, 2), F.lit(False))) == 0).alias("values_known"))
    once = n(votes.groupBy("session_id", "opinion_id").count().where("count > 1"), "pairs_unique")
    return same.crossJoin(values).crossJoin(once)
