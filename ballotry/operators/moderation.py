"""Review of opinions, candidates for a session, and the public rows of a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

#: Which action leads from which status to which.
TRANSITIONS = [("approve", "pending", "approved"), ("reject", "pending", "rejected"), ("hide", "approved", "hidden"), ("restore", "hidden", "approved"), ("restore", "rejected", "approved"), ("keep", "approved", "approved")]


def with_counts(opinions: DataFrame, counts: DataFrame, reports: DataFrame) -> DataFrame:
    """Opinions with their answers and reports, 0 where there are none."""
    n = reports.groupBy(F.col("opinion_id").alias("id")).agg(F.count("*").alias("reports"))
    at = opinions.join(counts.withColumnRenamed("opinion_id", "id"), "id", "left").join(n, "id", "left")
    return at.fillna(0, ["agree", "disagree", "pass", "unrelated", "reports"])


def review_queue(rows: DataFrame) -> DataFrame:
    """What waits for review: pending ones, and approved ones with three more unrelated answers,
    or more reports, than at the last review."""
    grown = (F.col("unrelated") - F.col("reviewed_unrelated") >= 3) | (F.col("reports") > F.col("reviewed_reports"))
    return rows.where((F.col("status") == "pending") | ((F.col("status") == "approved") & grown))


def hidden(opinions: DataFrame) -> DataFrame:
    return opinions.where(F.col("status").isin("hidden", "rejected"))


def reports_by_category(reports: DataFrame) -> DataFrame:
    return reports.groupBy("opinion_id", "category").agg(F.count("*").alias("n"))


def candidates(sessions: DataFrame, opinions: DataFrame, answers: DataFrame) -> DataFrame:
    """(session_id, id): approved opinions that a session neither wrote nor answered. Every
    session meets every approved opinion; opinions are the small side of that product, which
    Spark broadcasts while they are."""
    approved = opinions.where("status = 'approved'").select("id", "tag_id", "author_session")
    at = sessions.select("session_id").join(approved, ~F.col("author_session").eqNullSafe(F.col("session_id")))
    return at.join(answers.select("session_id", F.col("opinion_id").alias("id")), ["session_id", "id"], "left_anti").select("session_id", "id", "tag_id")


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "action string, from_status string, to_status string")


def apply_actions(opinions: DataFrame, actions: DataFrame) -> DataFrame:
    """actions(id, action, expected_revision) on opinions(id, status, revision): next_status and
    next_revision, or a conflict where the status or the revision isn't the expected one."""
    rules = transitions(opinions.sparkSession).withColumnRenamed("from_status", "status")
    at = actions.join(opinions, "id", "left").join(rules, ["action", "status"], "left")
    ok = F.col("to_status").isNotNull() & (F.col("revision") == F.col("expected_revision"))
    return at.select("id", "action", F.coalesce(ok, F.lit(False)).alias("applied"), F.when(ok, F.col("to_status")).otherwise(F.col("status")).alias("next_status"), F.when(ok, F.col("revision") + 1).otherwise(F.col("revision")).alias("next_revision"))


def public_opinions(opinions: DataFrame) -> DataFrame:
    """Released opinions: sources as an array, no date for 0."""
    return opinions.where("status = 'approved'").select("id", "tag_id", F.from_json("source_ids", T.ArrayType(T.StringType())).alias("source_ids"), S.iso_day("created_at").alias("created_date"))


def public_responses(answers: DataFrame, members: DataFrame) -> DataFrame:
    """Released answers to the released opinions; unrelated ones have no analysis value."""
    label = F.when(F.col("value") == -1, "agree").when(F.col("value") == 1, "disagree").when(F.col("value") == 0, "pass").otherwise("unrelated")
    at = answers.join(members.select(F.col("id").alias("opinion_id")), "opinion_id", "left_semi")
    return at.select("session_id", "opinion_id", label.alias("response"), F.when(F.col("value") != 2, F.col("value")).alias("analysis_value"))


def public_presentations(impressions: DataFrame, watermark: int | None = None) -> DataFrame:
    """A row for each (session, opinion) an event speaks of: displayed, answered, retired, by
    events up to a watermark of the event number, never by time."""
    seen = impressions if watermark is None else impressions.where(F.col("event_id") <= watermark)
    has = lambda t: F.bool_or(F.col("type") == t)
    return seen.groupBy("session_id", "opinion_id").agg(has("shown").alias("displayed"), has("answered").alias("answered"), has("retired").alias("retired"))


#: Tables an administrator may read as they are, and of sessions which columns (no token).
DUMPED = ("sessions", "impressions", "events", "votes", "opinions", "result_snapshots", "moderation_actions", "reports")
SESSION_COLUMNS = ("id", "phase", "created_at", "ended_at", "notice_version", "last_seen_at")


def dump(name: str, rows: DataFrame, seq: str, after: int, limit: int = 100) -> DataFrame:
    """(cursor, ..., next): the rows of a table after a cursor, in order. next is where to go on, null on the
    last page."""
    if name not in DUMPED or after < 0:
        raise ValueError("no such table or cursor")
    shown = [c for c in rows.columns if c != seq and (name != "sessions" or c in SESSION_COLUMNS)]
    page = rows.where(F.col(seq) > after).select(F.col(seq).alias("cursor"), *shown).orderBy("cursor").limit(limit)
    whole = page.agg(F.when(F.count("*") == limit, F.max("cursor")).alias("next"))
    return page.crossJoin(F.broadcast(whole))  # one row


def queue_order(rows: DataFrame) -> DataFrame:
    """The review queue, the oldest first."""
    return review_queue(rows).orderBy("created_at", "id")


def latest(rows: DataFrame, most: int, when: str = "created_at") -> DataFrame:
    """The latest rows: 100 actions, 50 releases. Spark keeps that many of each task and no more."""
    return rows.orderBy(F.desc(when), F.desc("id")).limit(most)
