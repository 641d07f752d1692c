"""The scatter matrix, principal axes, projection and connectivity of ballots.

Ballots stay in long form, so a missing answer is an absent row. What comes to the driver is
one row for each pair of retained opinions, whatever the number of sessions; of more than
MAX_OPINIONS the votes are dealt once into blocks of sessions; each multiplication then is one pass over
the blocks without a shuffle, no pair is made, and each task sends one number an opinion.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources.files import Tables
from .components import components

#: Retained opinions up to which the pair matrix is gathered (a few million cells).
MAX_OPINIONS = 2000


def scatter(votes: DataFrame, kept: DataFrame) -> DataFrame:
    """(j, k, c) with j <= k: sums over sessions of products of centred answers to two opinions,
    where both were answered. Counts, sums and products of answers are whole numbers, so the
    result doesn't depend on partitions. A session's answers meet in one array, so that the
    votes are shuffled once and a pair is made where its session is."""
    at = votes.join(kept.select("opinion_id"), "opinion_id", "left_semi")
    rows = at.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("opinion_id", "value"))).alias("v"))
    one = rows.select("v", F.posexplode("v").alias("p", "x"))
    pairs = one.select("x", F.explode(F.slice("v", F.col("p") + 1, F.size("v") - F.col("p"))).alias("y"))
    value = lambda c: F.col(f"{c}.value").cast("long")
    sums = pairs.groupBy(F.col("x.opinion_id").alias("j"), F.col("y.opinion_id").alias("k")).agg(F.count("*").alias("n"), F.sum(value("x")).alias("sj"), F.sum(value("y")).alias("sk"), F.sum(value("x") * value("y")).alias("p"))
    mean = lambda c: kept.select(F.col("opinion_id").alias(c), F.col("mean").alias(f"m{c}"))
    full = sums.join(mean("j"), "j").join(mean("k"), "k")
    return full.select("j", "k", (F.col("p") - F.col("mk") * F.col("sj") - F.col("mj") * F.col("sk") + F.col("n") * F.col("mj") * F.col("mk")).alias("c"))


def dense(pairs: DataFrame, ids: list[str]) -> np.ndarray:
    at, c = {o: i for i, o in enumerate(ids)}, np.zeros((len(ids), len(ids)))
    for j, k, v in pairs.collect():
        c[at[j], at[k]] = c[at[k], at[j]] = v
    return c


@dataclass
class Spread:
    """The scatter matrix as what it does to a vector, and its trace."""

    multiply: Callable[[np.ndarray], np.ndarray]
    trace: float
    release: Callable[[], object] = lambda: None


def spread(votes: DataFrame, kept: DataFrame, ids: list[str]) -> Spread:
    """The scatter matrix of the retained opinions, in the order of ids: gathered up to
    MAX_OPINIONS, else left in the votes, where a multiplication is a job."""
    if len(ids) <= MAX_OPINIONS:
        c = dense(scatter(votes, kept), ids)
        return Spread(lambda v: c @ v, float(np.trace(c)))
    tables = Tables(votes.sparkSession, "blocks")
    blocks = session_blocks(votes, kept, ids, tables)
    trace = blocks.agg(F.sum("square")).first()[0] or 0.0
    return Spread(lambda v: multiplied(blocks, v), float(trace), lambda: files.delete(votes.sparkSession, tables.folder))


#: Answers of a block, and numbers of partial sums that the driver adds itself.
BLOCK_ANSWERS, GATHERED = 1_000_000, 8_000_000


def session_blocks(votes: DataFrame, kept: DataFrame, ids: list[str], tables: Tables) -> DataFrame:
    """(block, starts, places, off, square): the centred answers of whole sessions, as arrays, with the
    places of their opinions in ids and the sum of their squares. The votes are shuffled for this once;
    all multiplications read it as it is written."""
    spark = votes.sparkSession
    place = spark.createDataFrame([(o, i) for i, o in enumerate(ids)], "opinion_id string, place int")
    off = votes.join(kept.select("opinion_id", "mean").join(place, "opinion_id"), "opinion_id").select("session_id", "place", (F.col("value") - F.col("mean")).alias("off"))
    count = max(1, -(-votes.count() // BLOCK_ANSWERS))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("session_id", "ascending"), ("place", "ascending")])
        session = t["session_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(session, prepend=-1))
        values = t["off"].to_numpy()
        data = [starts.astype("<i8"), t["place"].to_numpy().astype("<i4"), values.astype("<f8")]
        return pa.table({"block": t["block"][:1].combine_chunks(), **{n: pa.array([d.tobytes()], pa.binary()) for n, d in zip(("starts", "places", "off"), data, strict=True)}, "square": [float(values @ values)]})

    at = off.withColumn("block", F.pmod(F.xxhash64("session_id"), F.lit(count)).cast("int"))
    return tables.cut(at.groupBy("block").applyInArrow(pack, "block int, starts binary, places binary, off binary, square double"))


def multiplied(blocks: DataFrame, v: np.ndarray) -> np.ndarray:
    """The scatter matrix of blocks times a vector, or some vectors as columns: each task adds up its
    blocks, and the driver the tasks' sums. Where these are many, tasks add them up in between."""
    columns = v.reshape(len(v), -1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = np.zeros(columns.shape), -1
        for batch in batches:
            for block, starts, places, off in zip(*(batch[n].to_pylist() for n in ("block", "starts", "places", "off")), strict=True):
                starts, places, off = np.frombuffer(starts, "<i8"), np.frombuffer(places, "<i4"), np.frombuffer(off, "<f8")
                lengths = np.diff(starts, append=len(off))
                for c in range(columns.shape[1]):
                    x = np.add.reduceat(off * columns[places, c], starts)
                    out[:, c] += np.bincount(places, off * np.repeat(x, lengths), len(out))
                first = max(first, block)
        if first >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([out.tobytes()], pa.binary())], ["at", "sums"])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        whole = np.sum([np.frombuffer(s, "<f8") for s in t["sums"].to_pylist()], axis=0)
        return pa.table({"at": t["at"][:1].combine_chunks(), "sums": pa.array([whole.tobytes()], pa.binary())})

    partial = blocks.mapInArrow(add, "at long, sums binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks * columns.size > GATHERED:
        partial = partial.groupBy(F.pmod("at", F.lit(max(1, math.isqrt(tasks)))).alias("group")).applyInArrow(join, "at long, sums binary")
    sums = [np.frombuffer(s, "<f8") for _, s in sorted((r["at"], bytes(r["sums"])) for r in partial.collect())]
    return np.sum(sums, axis=0).reshape(v.shape) if sums else np.zeros(v.shape)


#: Opinions of the answer patterns with which one pass over all others begins, and such passes.
HUB_OPINIONS, HUB_PASSES = 2000, 3


def patterns_of(votes: DataFrame, sessions: DataFrame, kept: DataFrame) -> DataFrame:
    """(session_id, o): the opinions that each session answered other than pass, in order."""
    marks = votes.where("value <> 0").join(kept.select("opinion_id"), "opinion_id", "left_semi").join(sessions.select("session_id"), "session_id", "left_semi")
    rows = sessions.select("session_id").join(marks.groupBy("session_id").agg(F.array_sort(F.collect_set("opinion_id")).alias("o")), "session_id", "left")
    return rows.select("session_id", F.coalesce("o", F.array().cast("array<string>")).alias("o"))


def overlap_components(votes: DataFrame, sessions: DataFrame, kept: DataFrame, shared: int = 3) -> DataFrame:
    """(session_id, component): sessions that share so many (2 or 3) substantive answers' opinions are
    linked, and a component is named by its least session.

    Sessions of one set of opinions are one pattern. A few passes without a shuffle find what the
    densest patterns reach: nearly everything where sessions answer a lot alike, and all of it is one
    group from there on. What is left is linked exactly through combinations of opinions that stand in
    more than one group: combinations are made of pairs that do so themselves, each group gives a
    combination once, and it leads to the least group that has it. So no two patterns are compared,
    and no row stands for two of them."""
    if shared not in (2, 3):
        raise ValueError("shared: 2 or 3")
    tables = Tables(votes.sparkSession, "overlap")
    return _components(tables.cut(patterns_of(votes, sessions, kept)), tables, shared)


def _components(answered: DataFrame, tables: Tables, shared: int) -> DataFrame:
    patterns = tables.cut(answered.where(F.size("o") >= shared).groupBy("o").agg(F.min("session_id").alias("name")))
    grouped = tables.cut(_reached(patterns, shared, tables))
    links = tables.cut(_links(grouped, shared, tables))
    inner = grouped.where("name <> grp").select(F.col("name").alias("a"), F.col("grp").alias("b"))
    named, _ = components(patterns.select(F.col("name").alias("node")), inner.union(links))
    labelled = patterns.join(named.select(F.col("node").alias("name"), "component"), "name").select("o", "component")
    # sessions with fewer opinions are alone, even those that have the same ones
    return answered.join(labelled, "o", "left").select("session_id", F.coalesce("component", "session_id").alias("component"))


def connected(votes: DataFrame, sessions: DataFrame, kept: DataFrame) -> bool:
    """Whether sessions that share three substantive answers' opinions form one component. A session
    without three such opinions is alone; no sessions at all aren't connected."""
    tables = Tables(votes.sparkSession, "overlap")
    answered = tables.cut(patterns_of(votes, sessions, kept))
    at = answered.agg(F.count("*").alias("n"), F.min(F.size("o")).alias("least"), F.max(F.struct(F.size("o"), "o")).alias("top")).first()
    if at["n"] < 2 or at["least"] < 3:
        return at["n"] == 1
    if answered.where(F.size(F.array_intersect("o", F.lit(list(at["top"]["o"])))) < 3).isEmpty():
        return True  # one session has three with each other one
    return _components(answered, tables, 3).select("component").distinct().limit(2).count() == 1


def _reached(patterns: DataFrame, shared: int, tables: Tables) -> DataFrame:
    """(name, o, grp): grp is one name for all that hub passes from the densest pattern reach, and each
    other pattern's own name. A pass takes bounded hubs to the tasks with the plan."""
    top = patterns.orderBy(F.size("o").desc(), "name").limit(1).collect()
    if not top:
        return patterns.withColumn("grp", F.col("name"))
    first, hubs = top[0]["name"], [list(top[0]["o"])]
    at = patterns.withColumn("reached", F.col("name") == first)
    for _ in range(HUB_PASSES):
        near = F.lit(False)
        for hub in hubs:
            near = near | (F.size(F.array_intersect("o", F.lit(hub))) >= shared)
        at = tables.cut(at.select("name", "o", "reached", (~F.col("reached") & near).alias("new")))
        hubs = _hubs(at.where("new"))
        at = at.select("name", "o", (F.col("reached") | F.col("new")).alias("reached"))
        if not hubs:
            break
    return at.select("name", "o", F.when(F.col("reached"), F.lit(first)).otherwise(F.col("name")).alias("grp"))


def _hubs(patterns: DataFrame) -> list[list[str]]:
    """The densest of these patterns, of HUB_OPINIONS opinions in all (one at least)."""
    out, size = [], 0
    for (o,) in patterns.select("o").orderBy(F.size("o").desc(), "o").limit(64).collect():
        if out and size + len(o) > HUB_OPINIONS:
            break
        out.append(list(o))
        size += len(o)
    return out


def _across(rows: DataFrame, key: str) -> DataFrame:
    """(key, least): what stands in more than one group, with the least of these; rows(grp, key)."""
    return rows.groupBy(key).agg(F.min("grp").alias("least"), F.max("grp").alias("_most")).where("least <> _most").drop("_most")


def _links(grouped: DataFrame, shared: int, tables: Tables) -> DataFrame:
    """(a, b): groups that have a combination of so many opinions in common, by way of the least one
    that has it. Opinions, then pairs, then threes: each made only of what stands in several groups."""
    one = grouped.select("name", "grp", F.explode("o").alias("x"))
    one = one.join(_across(one.select("grp", "x"), "x").select("x"), "x", "left_semi")
    sets = tables.cut(one.groupBy("name", "grp").agg(F.array_sort(F.collect_set("x")).alias("o")).select("grp", "o").where(F.size("o") >= shared).distinct().withColumn("set", F.monotonically_increasing_id()))
    pairs = sets.select("set", "grp", F.explode(F.flatten(F.transform("o", lambda a, i: F.transform(F.slice("o", i + 2, F.size("o")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    several = _across(pairs.select("grp", "x"), "x")
    if shared == 2:
        found = pairs.select("grp", "x").distinct().join(several, "x")
    else:
        good = pairs.join(several.select("x"), "x", "left_semi").groupBy("set", "grp").agg(F.array_sort(F.collect_list("x")).alias("p"))
        by = good.withColumn("next", F.map_from_entries(F.transform(F.array_distinct(F.transform("p", lambda p: p["a"])), lambda a: F.struct(a, F.transform(F.filter("p", lambda q: q["a"] == a), lambda q: q["b"])))))
        threes = by.select("grp", F.explode(F.flatten(F.transform("p", lambda p: F.transform(
            F.array_intersect(F.coalesce(F.try_element_at("next", p["a"]), F.array().cast("array<string>")), F.coalesce(F.try_element_at("next", p["b"]), F.array().cast("array<string>"))),
            lambda c: F.struct(p["a"].alias("a"), p["b"].alias("b"), c.alias("c")),
        )))).alias("x")).distinct()
        threes = tables.cut(threes)
        found = threes.join(_across(threes, "x"), "x")
    return found.where("grp <> least").select(F.col("grp").alias("a"), F.col("least").alias("b")).distinct()


@dataclass
class Model:
    """Means and two axes over retained opinions, and group centres: what a later projection needs."""

    opinion_ids: list[str]
    means: list[float]
    components: list[list[float]]
    min_substantive: int = 6
    centers: list[tuple[float, float, int]] = field(default_factory=list)
    version: int = 1
    explained: float | None = None
    iterations: tuple[int, int] = (0, 0)
    warm: tuple[bool, bool] = (False, False)


def _axis(multiply, width: int, axis: int, limit: int, initial: np.ndarray | None = None) -> tuple[np.ndarray, int, bool]:  # noqa: ANN001
    """Power iteration from a fixed start, or from an earlier axis with a little of that start."""
    cold = np.sin(np.arange(1, width + 1) * (axis + 1) * 1.731) + 0.2
    cold /= np.linalg.norm(cold)
    warm = initial is not None and np.linalg.norm(initial) > 1e-10
    v = initial / np.linalg.norm(initial) + 1e-3 * cold if warm else cold
    v = v / np.linalg.norm(v)
    used = 0
    for used in range(1, limit + 1):
        new = multiply(v)
        size = np.linalg.norm(new)
        if size < 1e-10:
            return _axis(multiply, width, axis, limit) if warm and used == 1 else (np.zeros(width), used, warm)
        new = new / size
        change = ((new - (-1 if new @ v < 0 else 1) * v) ** 2).sum()
        v = new
        if change <= 1e-16:
            break
    top = int(np.argmax(np.abs(v)))
    return (-v if v[top] < 0 else v), used, warm


def principal(c: Spread, ids: list[str], means: list[float], iterations: int = 100, min_substantive: int = 6, previous: Model | None = None) -> Model:
    """Two principal axes of a scatter matrix; the second from what the first leaves."""
    start: list[np.ndarray | None] = [None, None]
    if previous is not None and previous.version == 1 and len(set(previous.opinion_ids)) == len(previous.opinion_ids) and np.isfinite(previous.components).all():
        old = {o: j for j, o in enumerate(previous.opinion_ids)}
        overlap = sum(o in old for o in ids)
        if overlap >= 2 and overlap / max(len(ids), len(old)) >= 0.8:
            start = [np.array([axis[old[o]] if o in old else 0.0 for o in ids]) for axis in previous.components]
    pc1, n1, w1 = _axis(c.multiply, len(ids), 0, iterations, start[0])

    def rest(v: np.ndarray) -> np.ndarray:
        out = c.multiply(v - (v @ pc1) * pc1)
        return out - (out @ pc1) * pc1

    pc2, n2, w2 = _axis(rest, len(ids), 1, iterations, start[1])
    both = np.stack([pc1, pc2], axis=1)
    explained = float((both * c.multiply(both)).sum() / c.trace) if c.trace else math.nan
    c.release()
    return Model(list(ids), list(means), [pc1.tolist(), pc2.tolist()], min_substantive, [], 1, explained, (n1, n2), (w1, w2))


def model_frame(votes: DataFrame, model: Model) -> DataFrame:
    """The model as rows (opinion_id, mean, pc1, pc2): one a retained opinion."""
    rows = list(zip(model.opinion_ids, model.means, *model.components, strict=True))
    return votes.sparkSession.createDataFrame(rows, "opinion_id string, mean double, pc1 double, pc2 double")


def project(votes: DataFrame, model: Model) -> DataFrame:
    """(session_id, x, y, group): sessions with enough substantive answers to the model's
    opinions, at their place on its axes and with the nearest saved centre (the first of
    equals; null if the model has none)."""
    at = votes.where(F.col("value").isin(-1, 0, 1)).join(model_frame(votes, model), "opinion_id")
    off = F.col("value") - F.col("mean")
    sums = at.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") != 0).alias("s"), F.sum(off * F.col("pc1")).alias("x"), F.sum(off * F.col("pc2")).alias("y"))
    scale = F.sqrt(F.lit(float(len(model.opinion_ids))) / F.greatest("n", F.lit(1)))
    out = sums.where(F.col("s") >= model.min_substantive).select("session_id", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))
    if not model.centers:
        return out.withColumn("group", F.lit(None).cast("int"))
    near = [F.struct((F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)).alias("d"), F.lit(i).alias("i"), F.lit(g).alias("g")) for i, (cx, cy, g) in enumerate(model.centers)]
    return out.withColumn("group", (F.least(*near) if len(near) > 1 else near[0])["g"])
