"""Event and vote streams, and the batch results they must equal.

Streams deduplicate within a watermark, so their state is bounded by its delay; counters are
sums over a signed log, so a removal is a row like any other. Release membership goes by the
sequence number of a row, never by event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows of a micro-batch of a log that is cut into several.
BATCH_ROWS = 8_000_000
FLAGS = {"agree": -1, "disagree": 1, "pass": 0, "unrelated": 2}


def read_stream(spark: SparkSession, path: str, pattern: str, files: int = 16) -> DataFrame:
    """A table's files as a stream, some of them at a time, with the schema they have."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(path)


def pieces(log: DataFrame, seq: str, rows: int = BATCH_ROWS) -> list[DataFrame]:
    """A log cut by its sequence number into pieces of about so many rows, in order; all rows are in one."""
    n = -(-log.count() // rows)
    ends = sorted(set(log.approxQuantile(seq, [i / n for i in range(1, n)], 0.001))) if n > 1 else []
    at = F.lit(0)
    for end in ends:
        at = at + (F.col(seq) > end).cast("int")
    return [log.where(at == i) for i in range(len(ends) + 1)]


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """The first of the events of each id. The same call works on streams and tables."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def counters(log: DataFrame) -> DataFrame:
    """log(opinion_id, value, sign): answers that came (1) and went (-1) -> counts by opinion."""
    return log.groupBy("opinion_id").agg(*(F.sum(F.when(F.col("value") == v, F.col("sign")).otherwise(0)).cast("long").alias(n) for n, v in FLAGS.items()))


def run_available(result: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there now, to a table in memory, and stop. From the same checkpoint a later
    run goes on where this one ended."""
    return result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new rows to Parquet exactly once."""
    return result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_display(events: DataFrame) -> DataFrame:
    """When each impression was shown first."""
    return events.where("type = 'shown'").groupBy("session_id", "opinion_id").agg(F.min("ts").alias("displayed_at"))


def retirements(events: DataFrame) -> DataFrame:
    """The event by which each impression was retired: the first, whatever came after."""
    return events.where("type = 'retired'").groupBy("session_id", "opinion_id").agg(F.min("event_id").alias("event_id"))


def outstanding(events: DataFrame) -> DataFrame:
    """Each session's latest impression that is neither answered nor retired."""
    at = events.groupBy("session_id", "opinion_id").agg(F.max(F.when(F.col("type") == "shown", F.col("event_id"))).alias("shown"), F.bool_or(F.col("type") != "shown").alias("closed"))
    top = at.where("shown is not null and not closed").groupBy("session_id").agg(F.max(F.struct("shown", "opinion_id")).alias("top"))
    return top.select("session_id", "top.opinion_id", F.col("top.shown").alias("event_id"))


def phases(events: DataFrame, quiet: int = 3) -> DataFrame:
    """Each session's phase: ended after its first retirement, reflect after so many answers, else
    active; ended_at is set once."""
    at = events.groupBy("session_id").agg(F.count_if(F.col("type") == "answered").alias("answers"), F.min(F.when(F.col("type") == "retired", F.col("event_id"))).alias("ended_at"))
    phase = F.when(F.col("ended_at").isNotNull(), "ended").when(F.col("answers") >= quiet, "reflect").otherwise("active")
    return at.select("session_id", phase.alias("phase"), "ended_at")


def revisions(log: DataFrame, key: str = "opinion_id", seq: str = "seq", state: str = "state") -> DataFrame:
    """How many times each key's state changed along a log; writing the same again isn't a change."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(seq))
    return log.withColumn("_b", before).groupBy(key).agg(F.count_if(~F.col("_b").eqNullSafe(F.col(state)) & F.col("_b").isNotNull()).alias("revision"))


def approval_delta(answers: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how community votes and sessions move when opinions enter or leave approval.
    before and after: (id, status). Counts by opinion don't move."""
    flag = lambda d, n: d.select(F.col("id").alias("opinion_id"), (F.col("status") == "approved").cast("int").alias(n))
    at = answers.join(flag(before, "old"), "opinion_id").join(flag(after, "new"), "opinion_id")
    one = at.groupBy("session_id").agg(F.sum("old").alias("o"), F.sum("new").alias("n"))
    return one.agg(F.coalesce(F.sum(F.col("n") - F.col("o")), F.lit(0).cast("long")).alias("votes"), (F.count_if(F.col("n") > 0) - F.count_if(F.col("o") > 0)).alias("sessions"))


def limited_posts(posts: DataFrame, most: int = 3) -> DataFrame:
    """A session's first posts, as pending ones."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    return posts.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("status", F.lit("pending"))
