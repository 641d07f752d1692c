"""Connected components of links between named things, in rounds that contract the graph.

Each round gives every name a fresh random place, lets each point at the least of its neighbours
(itself included), follows two pointers at once and contracts the links along them. What vanishes is
more than half of a chain and more of anything denser, so rounds are logarithmic. Each round's links
and labels are written before the next, so plans stay as long as one round. What is small enough for
one task whatever the input (SMALL arcs) is ended there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import Tables

#: Arcs that one task ends by union-find in memory.
SMALL = 200_000


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"old": list(up), "new": [root(x) for x in up]}, columns=["old", "new"])


def components(nodes: DataFrame, links: DataFrame, small: int = SMALL) -> tuple[DataFrame, int]:
    """nodes(node), links(a, b) of strings -> (node, component), the least node that can be reached, and
    the rounds that took. Links to themselves, repeated links and null ends change nothing."""
    tables, rounds = Tables(nodes.sparkSession, "components"), 0
    both = links.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a <> b")
    arcs = tables.cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tables.cut(nodes.select("node", F.col("node").cast("string").alias("name")))
    named = lambda up: labels.join(up, labels["name"] == up["old"], "left").select("node", F.coalesce("new", "name").alias("name"))
    while n := arcs.count():
        rounds += 1
        if n <= small:
            labels = tables.cut(named(arcs.coalesce(1).mapInPandas(_ended, "old string, new string")))
            break
        old = tables.count
        place = lambda c: F.xxhash64(F.col(c), F.lit(rounds))  # noqa: B023, E731
        least = arcs.groupBy("a").agg(F.min(F.struct(place("b").alias("h"), F.col("b").alias("at"))).alias("m"))
        one = tables.cut(least.select(F.col("a").alias("old"), F.when(place("a") <= F.col("m.h"), F.col("a")).otherwise(F.col("m.at")).alias("new")))
        two = one.select(F.col("old").alias("new"), F.col("new").alias("next"))
        up = tables.cut(one.join(two, "new").select("old", F.col("next").alias("new")))
        labels = tables.cut(named(up))
        to = lambda c: up.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))  # noqa: B023, E731
        arcs = tables.cut(arcs.join(to("a"), "a").join(to("b"), "b").select(F.col("a_new").alias("a"), F.col("b_new").alias("b")).where("a <> b").distinct())
        tables.drop_before(old + 1)
    first = labels.groupBy("name").agg(F.min("node").alias("component"))
    return labels.join(first, "name").select("node", "component"), rounds
