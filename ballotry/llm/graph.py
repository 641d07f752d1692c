"""Links between records that share buckets, and the components links make.

All of it is joins and grouped aggregates: no list of a bucket's members, no edge list and
no label table of unbounded size ever sits in one task, and none on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotry.sources.files import Tables

from .common import cut, release


#: Rows of a graph that one task takes.
TASK_ROWS = 200_000


def packed(df: DataFrame) -> tuple[DataFrame, int]:
    """df run once (cut) and read back in as few partitions as its rows need, and its rows.
    A graph shrinks from round to round; so do the tasks and files of what follows."""
    df = cut(df)
    n = df.count()
    release(df.sparkSession)
    return df.coalesce(tasks(n)), n


def tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def components(edges: DataFrame, native: bool = False) -> DataFrame:
    """Distributed union-find. edges(a, b) of whole numbers -> (node, component), the
    smallest node reachable; nodes without an edge to another are absent.

    Every round points each name at the smallest name of its neighbourhood and contracts
    the graph along these pointers. Names are the nodes' 64-bit hashes (one to one on 64-bit
    numbers) and are hashed anew each round, so the order has nothing to do with how nodes
    are numbered: all but the local minima of a fresh random order vanish, a third of a
    chain and less of anything denser stays, and rounds are logarithmic in the number of
    nodes. Once a graph, contracted or not, has no more arcs than a task takes (TASK_ROWS),
    one task ends it by union-find in memory: a bound that doesn't grow with the input.
    native: rounds go on to the end instead, so that all of it is DataFrame functions.
    Null ends are ignored; repeated edges and self-loops change nothing.
    """
    hashed = lambda *c: [F.xxhash64(x).alias(x) for x in c]
    # tables, not checkpoints: these would keep estimates of size, which joins multiply round by round
    tables = Tables(edges.sparkSession, "graph")
    both = edges.select("a", "b").where("a != b")
    both = tables.cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    both = both.coalesce(tasks(n))
    few = 0 if native else TASK_ROWS
    if n <= few and not native:
        return ended(both, "node", "component")
    whole = pieces = tasks(n)
    labels = both.select(F.col("a").alias("node")).distinct().coalesce(whole).withColumn("name", F.xxhash64("node"))
    arcs = both.select(*hashed("a", "b"))
    while n > few:
        old = tables.count
        up = tables.cut(arcs.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("name"), F.least("a", "least").alias("up")).coalesce(pieces))
        labels = tables.cut(labels.join(up, "name", "left").select("node", F.xxhash64(F.coalesce("up", "name")).alias("name")).coalesce(whole))
        to = lambda end: up.select(F.col("name").alias(end), F.col("up").alias(f"{end}_up"))  # noqa: B023, E731
        moved = arcs.join(to("a"), "a").coalesce(pieces).join(to("b"), "b").where("a_up != b_up")
        arcs = tables.cut(moved.select(F.xxhash64("a_up").alias("a"), F.xxhash64("b_up").alias("b")).distinct().coalesce(pieces))
        n = arcs.count()
        pieces = tasks(n)
        arcs = arcs.coalesce(pieces)
        tables.drop_before(old + 1)
    if n:
        labels = labels.join(ended(arcs, "name", "up"), "name", "left").select("node", F.coalesce("up", "name").alias("name"))
    labels = tables.cut(labels.coalesce(whole))
    tables.drop_before(tables.count)
    least = labels.groupBy("name").agg(F.min("node").alias("component"))
    return labels.join(least, "name").select("node", "component").coalesce(whole)


def ended(arcs: DataFrame, end: str, least: str) -> DataFrame:
    """arcs(a, b), no more than a task takes -> (end, the smallest end reachable), by union-find in one task."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = {}

        def root(x: int) -> int:
            while (over := up[x]) != x:
                up[x] = x = up[over]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], [end, least])

    return arcs.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(join, f"{end} long, {least} long")


def stars(members: DataFrame) -> DataFrame:
    """members(key, node) -> edges(a, b) from every node to its bucket's smallest
    and to its largest. As many rows as members, never their square."""
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    at = members.join(ends, "key")
    return at.select(F.explode(F.array(F.struct(F.col("node").alias("a"), F.col("low").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()


def crowded(members: DataFrame) -> DataFrame:
    """members(key, node) of the buckets that hold more than one node."""
    many = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    return members.join(many.select("key"), "key", "left_semi")


def orphans(members: DataFrame, near: DataFrame) -> DataFrame:
    """(key, node, stray) of the buckets that have a stray among two members or more besides their
    ends: a node without an edge of near(a, b) to either end, or, where the ends have none to each
    other, without one to the first end. It may still be close to any other member, stray or not.
    Ends have been compared with all, and members that aren't strays are of one family."""
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    at = members.join(ends, "key").where("node != low and node != high")
    both = cut(near.select("a", "b").union(near.select("b", "a")).distinct())
    for end in ("low", "high"):
        at = at.join(both.select(F.col("a").alias("node"), F.col("b").alias(end), F.lit(True).alias(f"by_{end}")), ["node", end], "left")
    at = at.join(both.select(F.col("a").alias("low"), F.col("b").alias("high"), F.lit(True).alias("close")), ["low", "high"], "left")
    at = at.select("key", "node", (F.col("by_low").isNull() & (F.col("by_high").isNull() | F.col("close").isNull())).alias("stray"))
    some = at.groupBy("key").agg(F.bool_or("stray").alias("any"), F.count("*").alias("n")).where("any and n > 1")
    return at.join(some.select("key"), "key", "left_semi")


def unsettled(near: DataFrame, links: DataFrame) -> DataFrame:
    """(group, node, component, stray): families, the components of near(a, b), that
    links(a, b) leave in several components. Stray are nodes outside the largest."""
    family, parts = components(near), components(links)
    at = cut(family.select("node", F.col("component").alias("group")).join(parts, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component")))
    sizes = at.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return at.join(main.select("group", F.col("top.component").alias("main")), "group").select("group", "node", "component", (F.col("component") != F.col("main")).alias("stray"))


def blocks(groups: DataFrame, stray_rows: int = 256, member_rows: int = 2048) -> DataFrame:
    """groups(group, node, component, stray, ...) dealt to (group, block, chunk, stray),
    so that each stray meets each member of its group once and no (group, block, chunk)
    has many more than stray_rows + member_rows rows, however large the group."""
    sizes = groups.groupBy("group").agg(F.count_if("stray").alias("s"), F.count("*").alias("m")).where("s > 0 and m > 1")
    of = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = groups.join(sizes, "group").withColumns({"s": F.ceil(F.col("s") / stray_rows).cast("int"), "m": F.ceil(F.col("m") / member_rows).cast("int")})
    left = at.where("stray").withColumn("block", of(1, "s")).withColumn("chunk", every("m"))
    right = at.withColumn("stray", F.lit(False)).withColumn("chunk", of(2, "m")).withColumn("block", every("s"))
    both = left.unionByName(right).drop("s", "m")
    return both.repartition("group", "block", "chunk").sortWithinPartitions("group", "block", "chunk", F.desc("stray"))
