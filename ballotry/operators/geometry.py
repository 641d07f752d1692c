"""Hulls, scaling and regions of a two-dimensional map.

A group's hull is taken in two steps: every task reduces what it holds of a group to the hull
of that, and the hulls of hulls are joined, so a group of any size meets in a few rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite


def convex_hull(points: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the lowest x then y; without repeated,
    collinear or non-finite points. Fewer than three distinct points are returned as they are."""
    rest = sorted({(float(x), float(y)) for x, y in points if math.isfinite(x) and math.isfinite(y)})
    if len(rest) < 3:
        return rest

    def half(order: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(rest) + half(reversed(rest))


def padded_hull(points: Iterable[tuple[float, float]], padding: float = 8.0) -> list[tuple[float, float]]:
    """The hull of circles (a corner every 15 degrees) around a hull's corners; the plain hull
    where the padding isn't a positive number."""
    hull = convex_hull(points)
    if not (math.isfinite(padding) and padding > 0):
        return hull
    turn = np.arange(24) * math.pi / 12
    return convex_hull((x + padding * math.cos(a), y + padding * math.sin(a)) for x, y in hull for a in turn)


def hulls(points: DataFrame, by: str = "group", padding: float = 0.0) -> DataFrame:
    """points(by, x, y) -> (by, ord, x, y): the corners of each group's (padded) hull in order."""
    rows = points.where(finite("x", "y")).select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = rows.schema[by].dataType.simpleString()

    def reduce_(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for p in parts:
            for g, q in p.groupby(by, dropna=False):
                held[g] = convex_hull([*held.get(g, ()), *zip(q["x"], q["y"], strict=True)])
        yield pd.DataFrame([(g, x, y) for g, h in held.items() for x, y in h], columns=[by, "x", "y"])

    def finish(p: pd.DataFrame) -> pd.DataFrame:
        h = padded_hull(zip(p["x"], p["y"], strict=True), padding)
        return pd.DataFrame({by: p[by].iloc[0], "ord": range(len(h)), "x": [q[0] for q in h], "y": [q[1] for q in h]})

    return rows.mapInPandas(reduce_, f"`{by}` {kind}, x double, y double").groupBy(by).applyInPandas(finish, f"`{by}` {kind}, ord int, x double, y double")


def map_scaling(points: DataFrame) -> DataFrame:
    """points(..., x, y) with their place (px, py) on a map of 500 by 345: 15 per cent of the range
    (at least .1) is left free on each side."""
    good = points.where(finite("x", "y"))
    e = good.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))

    def place(c: str, start: float, end: float):  # noqa: ANN202
        pad = 0.15 * F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.1))
        share = (F.col(c) - F.col(f"lo_{c}") + pad) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 2 * pad)
        return start + F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * (end - start)

    return good.crossJoin(F.broadcast(e)).withColumns({"px": place("x", 35.0, 465.0), "py": place("y", 310.0, 35.0)}).drop("lo_x", "hi_x", "lo_y", "hi_y")


def region_centroids(points: DataFrame, by: str = "group") -> DataFrame:
    return points.groupBy(by).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def regions(points: DataFrame, by: str = "group", padding: float = 8.0) -> DataFrame:
    """(by, n, cx, cy, outline): each group's centre and the corners of its padded hull, in order."""
    corners = hulls(points, by, padding).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("c"))
    return region_centroids(points.where(finite("x", "y")), by).join(corners, by).select(by, "n", "cx", "cy", F.transform("c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("outline"))


def sample_first(points: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group in an order. Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return points.withColumn("rank", rank).where(F.col("rank") <= most)


#: Where a label may stand from its region's centre.
LABEL_OFFSETS = ((0, 0), (0, -26), (0, 26), (38, 0), (-38, 0), (28, -22), (-28, 22))


def place_labels(regions: list[tuple[str, float, float]], width: float = 74, height: float = 22) -> dict[str, tuple[float, float]]:
    """Places of a map's labels, one after the other: the offset with the least overlap of those
    before it (a thousand a unit of area) plus squared distance. A map has a few labels."""
    done: list[tuple[float, float]] = []
    out = {}
    for name, x, y in regions:
        cost = lambda o: 1000 * sum(max(0.0, width - abs(x + o[0] - a)) * max(0.0, height - abs(y + o[1] - b)) for a, b in done) + o[0] ** 2 + o[1] ** 2  # noqa: B023, E731
        dx, dy = min(LABEL_OFFSETS, key=cost)
        out[name] = x + dx, y + dy
        done.append(out[name])
    return out
