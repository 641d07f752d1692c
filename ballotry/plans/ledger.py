"""An append-only table whose rows are guarded and numbered, batch by batch, each exactly once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ballots
from .state import States


class Ledger:
    """Rows of a primary key, numbered without gaps within a part of it. A batch is checked against what
    is stored, gets its numbers after the last ones, and counts once its state is in place; of two
    batches that began from one state the second has to be done again."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], within: str, order: list[str]) -> None:
        self.spark, self.folder, self.schema, self.key, self.within, self.order = spark, folder, schema, key, within, order
        self.states = States(spark, f"{folder}/state")

    def rows(self, state: dict | None = None) -> DataFrame:
        state = state or self.states.current()
        wrote = [s["at"] for s in self.states.history() if s["number"] <= state["number"]] if state else []
        return self.spark.read.parquet(*(f"{at}/rows" for at in wrote)) if wrote else self.spark.createDataFrame([], f"{self.schema}, sequence long")

    def last(self, state: dict | None) -> DataFrame:
        kind = next(f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema if f.name == self.within)
        empty = f"{self.within} {kind}, number long"
        return self.spark.read.schema(empty).parquet(f"{state['at']}/last") if state else self.spark.createDataFrame([], empty)

    def append(self, batch: DataFrame, number: int, guard: Callable[[DataFrame, DataFrame], DataFrame] = lambda rows, _: rows, from_state: dict | None = None) -> int | None:
        """How many rows of a batch were new and let through; None if the batch was there before. guard
        takes the rows and what is stored. from_state: the state the caller began from."""
        state = from_state or self.states.current()
        if state and number <= state["batch"]:
            return None
        first = batch.groupBy(*self.key).agg(F.min_by(F.struct(*batch.columns), F.struct(*self.order)).alias("r")).select("r.*")
        new = guard(ballots.append_new(self.rows(state), first, self.key), self.rows(state))
        at = f"{self.folder}/batch-{number:012}-{uuid.uuid4().hex}"
        last = self.last(state)
        ballots.next_numbers(new, self.within, self.order, last).write.parquet(f"{at}/rows")
        stored = self.spark.read.parquet(f"{at}/rows")
        last.union(stored.groupBy(self.within).agg(F.max("sequence"))).groupBy(self.within).agg(F.max("number").alias("number")).write.parquet(f"{at}/last")
        if self.states.swap(state["number"] if state else 0, {"batch": number, "at": at}) is None:
            raise RuntimeError("another batch came between; this one is to be done again")
        return stored.count()
