"""The whole analysis: gates, axes, groups and bridges, as one driver program over DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ballots, bridges, cluster, matrix


@dataclass(frozen=True)
class Options:
    """All knobs. Invalid values raise ValueError."""

    min_substantive: int = 6
    min_sessions: int = 80
    min_opinion_votes: int = 3
    min_retained: int = 6
    pca_iterations: int = 100
    kmeans_iterations: int = 60
    min_group_size: int = 3
    max_groups: int = 4
    starts: int = 4
    min_silhouette: float = 0.45
    silhouette_targets: int = 256
    silhouette_references: int = 128
    min_bridge_votes: int = 10
    min_bridge_agreement: float = 0.6
    bridge_z: float = 1.96
    min_bridge_bound: float = 0.5

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
                raise ValueError(f"{f.name} must be a finite number")
            low, high = {"min_silhouette": (-1, 1), "min_bridge_agreement": (0, 1), "min_bridge_bound": (0, 1), "bridge_z": (0, 10), "max_groups": (2, 254)}.get(f.name, (1, 2**53 - 1))
            if not low <= v <= high or (f.type == "int" and v != int(v)):
                raise ValueError(f"{f.name} must be between {low} and {high}")


#: The profile from before the settings were tuned, for comparisons.
LEGACY = Options(min_sessions=8, min_silhouette=0.2, min_bridge_votes=3, bridge_z=0, min_bridge_bound=0)


@dataclass
class Result:
    status: str
    eligible: int
    minimum: int
    points: DataFrame | None = None  # session_id, x, y, group[, mine]
    groups: list[tuple[int, int]] = field(default_factory=list)
    bridges: DataFrame | None = None
    explained: float | None = None
    silhouette: float | None = None
    approximate: bool = False
    model: matrix.Model | None = None
    diagnostics: dict = field(default_factory=dict)
    #: What points and bridges are still computed from.
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of what was cached, once points and bridges have been used."""
        while self.held:
            self.held.pop().unpersist()


def analyze(votes: DataFrame, opinions: DataFrame | None = None, options: Options = Options(), previous: Result | None = None, mine: str | None = None) -> Result:  # noqa: B008
    """votes(session_id, opinion_id, value[, arrival]). Ends at the first gate that isn't passed.
    What is cached goes at such a gate; a ready result's with release(). Answers that aren't -1, 0 or 1, or to an unknown opinion, never count. Of a session's
    answers to an opinion the last by arrival counts; without that column there is one.
    mine: a session whose point is marked in a column mine."""
    out = Result("collecting", 0, options.min_sessions)
    try:
        return _analyze(out, votes, opinions, options, previous, mine)
    finally:
        if out.status != "ready":
            out.release()


def _analyze(out: Result, votes: DataFrame, opinions: DataFrame | None, o: Options, previous: Result | None, mine: str | None) -> Result:
    def kept_here(df: DataFrame) -> DataFrame:
        out.held.append(df.cache())
        return out.held[-1]

    votes = ballots.last_valid(votes, opinions) if "arrival" in votes.columns else ballots.valid(votes, opinions)
    votes = kept_here(votes)
    sessions = kept_here(ballots.eligible(votes, o.min_substantive))
    n = out.eligible = sessions.count()
    if n < o.min_sessions:
        return out
    own = kept_here(ballots.of_sessions(votes, sessions))
    kept = kept_here(ballots.retained(own, o.min_opinion_votes).orderBy("opinion_id"))
    rows = kept.collect()
    out.diagnostics["retained_opinions"] = len(rows)
    if len(rows) < o.min_retained:
        return out
    out.diagnostics["connected"] = matrix.connected(own, sessions, kept)
    if not out.diagnostics["connected"]:
        return out
    ids, means = [r["opinion_id"] for r in rows], [r["mean"] for r in rows]
    c = matrix.spread(own, kept, ids)
    if c.trace < 1e-8:
        c.release()
        out.status = "uniform"
        return out
    model = matrix.principal(c, ids, means, o.pca_iterations, o.min_substantive, previous.model if previous else None)
    out.model = model
    every = matrix.project(own, matrix.Model(ids, means, model.components, 0))
    points = kept_here(cluster.with_hashes(every))
    warm = cluster.previous_centers(points, previous.points.select("session_id", "group"), o.max_groups, o.min_group_size) if previous is not None and previous.points is not None else None
    grid = cluster.choose(points, n, o.min_group_size, o.max_groups, o.starts, o.kmeans_iterations, o.silhouette_targets, o.silhouette_references, warm)
    out.diagnostics["candidates"] = [(c.k, c.start, c.silhouette, None if c.sizes is None else c.sizes.tolist()) for c in grid]
    top = cluster.best(grid)
    if top is None or top.silhouette < o.min_silhouette:
        out.status = "unclear"
        return out
    order = np.lexsort((top.centers[:, 1], top.centers[:, 0]))
    rank = {int(old): new for new, old in enumerate(order)}
    model.centers = [(*map(float, top.centers[old]), new) for new, old in enumerate(order)]
    near = F.array(*(F.struct((F.pow(F.col("x") - float(x), 2) + F.pow(F.col("y") - float(y), 2)).alias("d"), F.lit(i).alias("i"), F.lit(rank[i]).alias("g")) for i, (x, y) in enumerate(top.labelled_by)))
    out.points = points.select(F.col("id").alias("session_id"), "x", "y", F.array_min(near)["g"].alias("group"))
    if mine is not None:
        out.points = out.points.withColumn("mine", F.col("session_id").eqNullSafe(F.lit(mine)))
    out.groups = [(new, int(top.sizes[old])) for new, old in enumerate(order)]
    counts = bridges.group_counts(own, out.points.select("session_id", "group"))
    out.bridges = bridges.bridges(counts, top.k, o.min_bridge_votes, o.min_bridge_agreement, o.bridge_z, o.min_bridge_bound)
    out.status, out.explained, out.silhouette, out.approximate = "ready", model.explained, top.silhouette, top.approximate
    return out
