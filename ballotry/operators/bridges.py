"""What all groups support: counts by group, evidence, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def group_counts(votes: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, opinion_id, agree, seen) over grouped sessions (session_id, group); a pass is seen."""
    at = votes.join(groups, "session_id")
    return at.groupBy("group", "opinion_id").agg(F.count_if(F.col("value") == -1).alias("agree"), F.count("*").alias("seen"))


def bridges(counts: DataFrame, groups: int, min_votes: int = 10, min_rate: float = 0.6, z: float = 1.96, min_bound: float = 0.5) -> DataFrame:
    """(opinion_id, score, groups) of opinions with evidence in every one of the groups. score:
    the product of (agree + 1) / (seen + 2)."""
    at = counts.withColumns({"rate": S.rate("agree", "seen"), "lower_bound": S.wilson_lower("agree", "seen", z), "ok": S.has_evidence("agree", "seen", min_votes, min_rate, z, min_bound)})
    detail = F.array_sort(F.collect_list(F.struct("group", "agree", "seen", "rate", "lower_bound"))).alias("groups")
    rows = at.groupBy("opinion_id").agg(detail, F.bool_and("ok").alias("ok"), F.count("*").alias("n"))
    return rows.where(F.col("ok") & (F.col("n") == groups)).select("opinion_id", S.consensus("groups").alias("score"), "groups")


def ranked(found: DataFrame) -> DataFrame:
    """By score, highest first, ties by opinion."""
    return found.orderBy(F.desc("score"), "opinion_id")
