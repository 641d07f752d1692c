"""Groups of points: k-means over a grid of starts, chosen by a sampled silhouette.

Points stay distributed. All candidates (numbers of groups and starts) advance together, one
pass over the points an iteration: a task returns sums for each candidate and group, so what
is gathered is a few dozen rows whatever the number of points. The silhouette takes bounded
samples by hash order within a group; only these are gathered. Up to FEW points, a bound that
doesn't grow with the input, the passes are so short that jobs would cost a hundred times as
much: the same functions then run over the points in memory, with the same results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import text_hash

TARGET_SALT, REFERENCE_SALT = 0x6A09E667, 0xBB67AE85
#: Points (some 60 bytes each) that are kept in memory for the passes.
FEW = 100_000
Points = DataFrame | pd.DataFrame


@dataclass
class Candidate:
    k: int
    start: int
    centers: np.ndarray | None
    warm: bool = False
    sizes: np.ndarray | None = None
    silhouette: float | None = None
    approximate: bool = False
    iterations: int = 0
    done: bool = False
    #: Centres that gave the last labels.
    labelled_by: np.ndarray | None = None


def with_hashes(points: DataFrame, id_col: str = "session_id") -> DataFrame:
    return points.select(F.col(id_col).alias("id"), "x", "y", text_hash(id_col, TARGET_SALT).alias("h1"), text_hash(id_col, REFERENCE_SALT).alias("h2"))


def at_ranks(points: Points, ranks: list[int]) -> list[tuple[str, float, float]]:
    """The points at given ranks of the order by (h1, id), found by counts of 65,536 ranges of the
    hash: only the ranges that hold a rank are ordered."""
    if isinstance(points, pd.DataFrame):
        order = points.sort_values(["h1", "id"])
        return [tuple(order[["id", "x", "y"]].iloc[r]) for r in ranks]
    counts = points.groupBy(F.shiftright("h1", 16).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    ends = np.cumsum([r["n"] for r in counts])
    bins = {int(counts[i]["bin"]): int(ends[i] - counts[i]["n"]) for i in np.searchsorted(ends, ranks, side="right")}
    rows = points.where(F.shiftright("h1", 16).isin(list(bins))).select("id", "x", "y", "h1").collect()
    found = {}
    for b, first in bins.items():
        for i, r in enumerate(sorted((r for r in rows if r["h1"] >> 16 == b), key=lambda r: (r["h1"], r["id"]))):
            found[first + i] = r["id"], r["x"], r["y"]
    return [found[r] for r in ranks]


def nearest(xy: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each point, the first of equals."""
    return ((xy[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)


def _farthest(points: Points, candidates: list[Candidate]) -> list[tuple[float, float, float]]:
    """For each candidate the point farthest from its centres so far (the first id of equals)."""
    centers = [c.centers for c in candidates]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for p in parts:
            xy = p[["x", "y"]].to_numpy()
            for c, at in enumerate(centers):
                d = ((xy[:, None, :] - at[None]) ** 2).sum(axis=2).min(axis=1)
                top = np.flatnonzero(d == d.max())
                i = top[np.argmin(p["id"].to_numpy()[top])] if len(top) > 1 else top[0]
                key = (-d[i], p["id"].iloc[i])
                if c not in best or key < best[c][0]:
                    best[c] = key, xy[i]
        yield pd.DataFrame([(c, -k[0], k[1], *xy) for c, (k, xy) in best.items()], columns=["c", "d", "id", "x", "y"])

    if isinstance(points, pd.DataFrame):
        return [tuple(r) for r in pd.concat(run([points])).sort_values("c")[["d", "x", "y"]].itertuples(index=False)]
    rows = points.select("id", "x", "y").mapInPandas(run, "c int, d double, id string, x double, y double").groupBy("c").agg(F.min(F.struct((-F.col("d")).alias("d"), "id", "x", "y")).alias("b")).collect()
    by = {r["c"]: r["b"] for r in rows}
    return [(-by[c]["d"], by[c]["x"], by[c]["y"]) for c in range(len(candidates))]


def _pass(points: Points, candidates: list[Candidate]) -> dict[tuple[int, int], tuple[int, float, float, int]]:
    """One pass: for each candidate and group the count, sums and points whose group changed."""
    now = [(c.centers, c.labelled_by) for c in candidates]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for p in parts:
            xy = p[["x", "y"]].to_numpy()
            for c, (centers, before) in enumerate(now):
                label = nearest(xy, centers)
                moved = np.ones(len(xy)) if before is None else label != nearest(xy, before)
                sums = [np.bincount(label, w, len(centers)) for w in (None, xy[:, 0], xy[:, 1], moved)]
                rows += [(c, g, int(sums[0][g]), sums[1][g], sums[2][g], int(sums[3][g])) for g in range(len(centers))]
        yield pd.DataFrame(rows, columns=["c", "g", "n", "x", "y", "moved"])

    if isinstance(points, pd.DataFrame):
        return {(r.c, r.g): (r.n, r.x, r.y, r.moved) for r in pd.concat(run([points])).itertuples()}
    found = points.select("x", "y").mapInPandas(run, "c int, g int, n long, x double, y double, moved long").groupBy("c", "g").agg(*(F.sum(v).alias(v) for v in ("n", "x", "y", "moved"))).collect()
    return {(r["c"], r["g"]): (r["n"], r["x"], r["y"], r["moved"]) for r in found}


def lloyd(points: Points, candidates: list[Candidate], iterations: int, min_size: int) -> None:
    """Advance all candidates until their labels stay; one whose group gets too small is dropped
    (its sizes stay None)."""
    for _ in range(iterations):
        active = [c for c in candidates if not c.done and c.centers is not None]
        if not active:
            return
        got = _pass(points, active)
        for i, c in enumerate(active):
            c.iterations += 1
            sums = [got.get((i, g), (0, 0.0, 0.0, 0)) for g in range(c.k)]
            c.sizes = np.array([s[0] for s in sums])
            if (c.sizes < min_size).any():
                c.sizes, c.centers, c.done = None, None, True
                continue
            c.labelled_by, c.centers = c.centers, np.array([[s[1] / s[0], s[2] / s[0]] for s in sums])
            c.done = not sum(s[3] for s in sums)
    for c in candidates:
        c.done = True


def _samples(points: Points, candidates: list[Candidate], most: int, order: str) -> dict[tuple[int, int], np.ndarray]:
    """For each candidate and group the first points in hash order: (id, x, y) of at most most."""
    by = [c.labelled_by for c in candidates]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in parts:
            xy = p[["x", "y"]].to_numpy()
            now = pd.concat([p.assign(c=c, g=nearest(xy, centers)) for c, centers in enumerate(by)])
            held = now if held is None else pd.concat([held, now])
            held = held.sort_values([order, "id"]).groupby(["c", "g"], sort=False).head(most)
        if held is not None:
            yield held[["c", "g", order, "id", "x", "y"]]

    if isinstance(points, pd.DataFrame):
        return {k: p[["id", "x", "y"]].to_numpy() for k, p in pd.concat(run([points])).groupby(["c", "g"])}
    rows = points.select("id", "x", "y", order).mapInPandas(run, f"c int, g int, {order} long, id string, x double, y double")
    out = rows.repartition("c", "g").groupBy("c", "g").applyInPandas(lambda p: p.sort_values([order, "id"]).head(most), rows.schema).toPandas()
    return {k: p[["id", "x", "y"]].to_numpy() for k, p in out.groupby(["c", "g"])}


def silhouette(sizes: np.ndarray, targets: list[np.ndarray], references: list[np.ndarray]) -> float:
    """Mean silhouette of targets against references, groups weighted by their sizes. targets
    and references: (id, x, y) rows of each group. A target without others of its group gives 0."""
    total = 0.0
    for g, rows in enumerate(targets):
        xy, mean, count = rows[:, 1:].astype(float), [], []
        for ref in references:
            far = np.hypot(*(xy[:, None, :] - ref[:, 1:].astype(float)[None]).transpose(2, 0, 1))
            other = rows[:, :1] != ref[:, 0][None]
            count.append(other.sum(axis=1))
            mean.append((far * other).sum(axis=1) / np.maximum(count[-1], 1))
        own, rest = mean[g], np.min([np.where(count[h] > 0, m, np.inf) for h, m in enumerate(mean) if h != g], axis=0)
        good = (count[g] > 0) & np.isfinite(rest)
        value = np.where(good, (np.where(good, rest, 0) - own) / np.maximum(np.maximum(own, np.where(good, rest, 0)), 1e-9), 0)
        total += value.sum() / len(rows) * sizes[g] / sizes.sum()
    return float(total)


def choose(points: DataFrame, n: int, min_size: int = 3, max_groups: int = 4, starts: int = 4, iterations: int = 60, targets: int = 256, references: int = 128, warm: np.ndarray | None = None) -> list[Candidate]:
    """All candidates in their order: the warm one first, then by groups and start. points:
    with_hashes(...), cached by the caller; n of them."""
    grid = [Candidate(len(warm), 0, np.array(warm, float), True)] if warm is not None else []
    if n <= FEW:
        points = points.select("id", "x", "y", "h1", "h2").toPandas()
    count = min(starts, n)
    first = at_ranks(points, [s * n // count for s in range(count)])
    cold = [Candidate(k, s, np.array([first[s][1:]], float)) for k in range(2, min(max_groups, n // min_size) + 1) for s in range(count)]
    for size in range(2, max_groups + 1):
        grow = [c for c in cold if c.k >= size and c.centers is not None]
        for c, (d, x, y) in zip(grow, _farthest(points, grow) if grow else [], strict=True):
            c.centers = None if d < 1e-16 else np.vstack([c.centers, [x, y]])
            c.done = c.centers is None
    grid += cold
    lloyd(points, grid, iterations, min_size)
    if grid and grid[0].warm and grid[0].sizes is not None:
        # a warm candidate stands for the first cold start of its number of groups
        grid = [c for c in grid if c.warm or (c.k, c.start) != (grid[0].k, 0)]
    good = [c for c in grid if c.sizes is not None]
    if good:
        t, r = _samples(points, good, targets, "h1"), _samples(points, good, references, "h2")
        for i, c in enumerate(good):
            c.silhouette = silhouette(c.sizes, [t[i, g] for g in range(c.k)], [r[i, g] for g in range(c.k)])
            c.approximate = bool((c.sizes > min(targets, references)).any())
    return grid


def best(candidates: list[Candidate]) -> Candidate | None:
    """The highest silhouette, the earliest of equals."""
    found = None
    for c in candidates:
        if c.silhouette is not None and (found is None or c.silhouette > found.silhouette):
            found = c
    return found


def previous_centers(points: DataFrame, labels: DataFrame, max_groups: int = 4, min_size: int = 3) -> np.ndarray | None:
    """Centres of an earlier grouping (session_id, group) among today's points; None unless there
    are 2 to max_groups groups of whole numbers from 0, each with enough points."""
    old = sorted(r[0] for r in labels.select("group").distinct().limit(max_groups + 1).collect())
    if not 2 <= len(old) <= max_groups or any(g is None or g < 0 for g in old):
        return None
    rows = {r["group"]: r for r in points.join(labels.withColumnRenamed("session_id", "id"), "id").groupBy("group").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).collect()}
    if any(g not in rows or rows[g]["n"] < min_size or not math.isfinite(rows[g]["x"]) for g in old):
        return None
    return np.array([[rows[g]["x"], rows[g]["y"]] for g in old])
