"""Encoding and counting of ballots: duplicate rules, validity, eligibility, counts.

Duplicate rules are max_by/min_by over a total arrival order: one partial and one final
aggregate on (session, opinion), no window and no sort of a session's ballots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .release import numbered


def valid(ballots: DataFrame, opinions: DataFrame | None = None) -> DataFrame:
    """Answers that are -1, 0 or 1, to a known opinion."""
    good = ballots.where(F.col("value").isin(-1, 0, 1))
    if opinions is not None:
        good = good.join(opinions.select(F.col("id").alias("opinion_id")), "opinion_id", "left_semi")
    return good


def last_valid(ballots: DataFrame, opinions: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """The last of a session's answers to an opinion. Invalid ones are dropped first, so they
    overwrite nothing."""
    return valid(ballots, opinions).groupBy("session_id", "opinion_id").agg(F.max_by("value", order).alias("value"))


def first_stored(ballots: DataFrame, order: str = "arrival") -> DataFrame:
    """The first of a session's answers to an opinion, of any value: stored answers don't change."""
    return ballots.groupBy("session_id", "opinion_id").agg(F.min_by("value", order).alias("value"))


def append_new(stored: DataFrame, arriving: DataFrame, key: list[str]) -> DataFrame:
    """Rows of arriving that are not stored yet, one for each key: an idempotent append."""
    return arriving.dropDuplicates(key).join(stored, key, "left_anti")


def eligible(votes: DataFrame, minimum: int = 6) -> DataFrame:
    """Sessions with enough answers other than pass."""
    return votes.groupBy("session_id").agg(F.count_if(F.col("value") != 0).alias("substantive")).where(F.col("substantive") >= minimum)


def of_sessions(votes: DataFrame, sessions: DataFrame) -> DataFrame:
    return votes.join(sessions.select("session_id"), "session_id", "left_semi")


def retained(votes: DataFrame, minimum: int = 3) -> DataFrame:
    """Opinions with enough answers, and the count, sum and mean of these (a pass is a 0)."""
    at = votes.groupBy("opinion_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("s"))
    return at.where(F.col("n") >= minimum).withColumn("mean", F.col("s") / F.col("n"))


def opinion_counts(answers: DataFrame) -> DataFrame:
    """Agree, disagree, pass and unrelated of each opinion, in one aggregate."""
    is_ = lambda v: F.count_if(F.col("value") == v)
    return answers.groupBy("opinion_id").agg(is_(-1).alias("agree"), is_(1).alias("disagree"), is_(0).alias("pass"), is_(2).alias("unrelated"))


def session_counts(answers: DataFrame, opinions: DataFrame) -> DataFrame:
    """Answers of each session to approved opinions."""
    approved = opinions.where("status = 'approved'").select(F.col("id").alias("opinion_id"))
    return answers.join(approved, "opinion_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n"))


def community_totals(answers: DataFrame, opinions: DataFrame) -> DataFrame:
    """Approved answers and sessions with one or more: sums of the sessions' counts, 0 for none."""
    return session_counts(answers, opinions).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("votes"), F.count("*").alias("sessions"))


def guarded(arriving: DataFrame, exists: list[tuple[DataFrame, list[str]]], missing: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows that have a partner in each of some tables and none in each of others, by the named columns."""
    for other, on in exists:
        arriving = arriving.join(other.select(*on).distinct(), on, "left_semi")
    for other, on in missing:
        arriving = arriving.join(other.select(*on).distinct(), on, "left_anti")
    return arriving


def next_numbers(rows: DataFrame, key: str, order: list[str], last: DataFrame, name: str = "sequence") -> DataFrame:
    """rows with a number for each key that goes on from last(key, number) without gaps, in an order.
    Ranges of (key, order) are numbered in parallel, so one key's rows need not meet in one task."""
    at = numbered(rows, [key, *order])
    first = at.groupBy(key).agg(F.min("rn").alias("_first"))
    had = last.select(key, F.col("number").alias("_had"))
    return at.join(first.join(had, key, "left"), key).withColumn(name, F.col("rn") - F.col("_first") + 1 + F.coalesce("_had", F.lit(0))).drop("rn", "_first", "_had")
