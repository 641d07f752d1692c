"""Counters kept up to date by merging micro-batches, each exactly once.

A batch's answers (with a sign, so that a removal is a row like any other) and changes of approval
become deltas of three tables: answers by (session, opinion), counts by opinion, approved answers by
session. A change of approval moves the sessions that answered that opinion, by their stored answers;
counts by opinion don't move. New tables are written aside, and a pointer that names them and the
batch moves by compare-and-set: a batch that comes again finds its number there and changes nothing,
one that died before the pointer is done again from the old tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.state import States
from .events import FLAGS, counters

TABLES = {"answers": "session_id string, opinion_id string, value int, n long", "opinions": "opinion_id string, agree long, disagree long, pass long, unrelated long", "sessions": "session_id string, n long", "approval": "opinion_id string, approved boolean, seq long"}


class Counters:
    """The tables in a folder. Batches are numbered as foreachBatch numbers them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.states = spark, folder, States(spark, f"{folder}/state")

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        state = state or self.states.current()
        return self.spark.read.schema(TABLES[name]).parquet(f"{state['at']}/{name}") if state else self.spark.createDataFrame([], TABLES[name])

    def totals(self) -> DataFrame:
        """votes and sessions of the community: sums of the sessions' approved answers."""
        return self.table("sessions").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("votes"), F.count_if(F.col("n") > 0).alias("sessions"))

    def merge(self, batch: DataFrame, number: int) -> bool:
        """One batch of (seq, session_id, opinion_id, value, sign, approved): answers have a sign, changes
        of approval have approved. False if the batch was merged before."""
        state = self.states.current()
        if state and number <= state["batch"]:
            return False
        spark, at = batch.sparkSession, f"{self.folder}/tables-{number:012}-{uuid.uuid4().hex}"
        old = {n: self.table(n, state) for n in TABLES} if state else {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
        came = batch.where("sign is not null").select("session_id", "opinion_id", "value", F.col("sign").cast("long").alias("n"))
        changed = batch.where("approved is not null").groupBy("opinion_id").agg(F.max_by("approved", "seq").alias("approved"), F.max("seq").alias("seq"))
        approval = old["approval"].unionByName(changed).groupBy("opinion_id").agg(F.max_by("approved", "seq").alias("approved"), F.max("seq").alias("seq"))
        approval.write.parquet(f"{at}/approval")
        approval = spark.read.schema(TABLES["approval"]).parquet(f"{at}/approval")
        approved = lambda df, name: df.where("approved").select("opinion_id", F.lit(1).alias(name))
        # answers that came count as approval stands after the batch; those stored move where it changed
        new = came.join(approved(approval, "yes"), "opinion_id").select("session_id", "n")
        moved = changed.select("opinion_id").join(approved(approval, "now"), "opinion_id", "left").join(approved(old["approval"], "was"), "opinion_id", "left")
        moved = moved.select("opinion_id", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).cast("long").alias("step")).where("step <> 0")
        stored = old["answers"].join(moved, "opinion_id").select("session_id", (F.col("n") * F.col("step")).alias("n"))
        sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").cast("long").alias("n")).where("n <> 0")
        sums(old["sessions"].union(new).union(stored), "session_id").write.parquet(f"{at}/sessions")
        sums(old["answers"].union(came), "session_id", "opinion_id", "value").write.parquet(f"{at}/answers")
        counts = old["opinions"].unionByName(counters(came.withColumnRenamed("n", "sign")))
        counts.groupBy("opinion_id").agg(*(F.sum(c).cast("long").alias(c) for c in FLAGS)).write.parquet(f"{at}/opinions")
        if self.states.swap(state["number"] if state else 0, {"batch": number, "at": at}) is None:
            raise RuntimeError("another writer merged meanwhile; this batch is to be done again")
        return True

    def run(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge what is there now, batch by batch, and stop; a later run from the checkpoint goes on."""
        return log.writeStream.foreachBatch(lambda df, n: self.merge(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
