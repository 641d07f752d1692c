"""Quality of groups and bridges against a known truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .release import numbered


def _pairs(n: str) -> F.Column:
    return F.col(n) * (F.col(n) - 1) / 2


def ari(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows, one row; null under two rows, 1
    where the expected range vanishes."""
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(_pairs("n")).alias("both"), F.sum("n").alias("total"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(_pairs("n")).alias(f"s_{c}"))
    at = both.crossJoin(side(a)).crossJoin(side(b))
    expected = F.try_divide(F.col(f"s_{a}") * F.col(f"s_{b}"), _pairs("total"))
    most = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return at.select(F.when(F.coalesce("total", F.lit(0)) < 2, None).when(F.abs(most - expected) < 1e-12, 1.0).otherwise(F.try_divide(F.col("both") - expected, most - expected)).alias("ari"))


def group_recovery(labels: DataFrame, truth: str, found: str) -> DataFrame:
    """For each true group the found group of the highest Jaccard index (the first of equals),
    with overlap, precision and recall."""
    cells = labels.where(F.col(truth).isNotNull() & F.col(found).isNotNull()).groupBy(truth, found).agg(F.count("*").alias("overlap"))
    t = labels.groupBy(truth).agg(F.count("*").alias("eligible"))
    f = labels.groupBy(found).agg(F.count("*").alias("size"))
    at = cells.join(t, truth).join(f, found)
    at = at.withColumn("jaccard", F.col("overlap") / (F.col("eligible") + F.col("size") - F.col("overlap")))
    top = at.groupBy(truth).agg(F.max_by(F.struct(found, "overlap", "eligible", "size", "jaccard"), F.struct("jaccard", -F.col(found))).alias("b"))
    return top.select(truth, F.col(f"b.{found}").alias(found), "b.overlap", S.rate("b.overlap", "b.size").alias("precision"), S.rate("b.overlap", "b.eligible").alias("recall"), "b.jaccard")


def bridge_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of found opinion_ids against true ones, null where nothing was found
    or nothing is true."""
    hit = found.join(truth, "opinion_id", "left_semi").agg(F.count("*").alias("hit"))
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return hit.crossJoin(n(found, "found")).crossJoin(n(truth, "true")).select("hit", "found", "true", F.try_divide("hit", "found").alias("precision"), F.try_divide("hit", "true").alias("recall"))


def evaluate(labels: DataFrame, found: DataFrame, true_found: DataFrame) -> DataFrame:
    """One row on one analysis: labels(session_id, truth, group), bridges found and true ones by opinion_id.
    ari, the mean Jaccard index of the true groups with their best found ones, and the bridges' precision
    and recall."""
    best = group_recovery(labels, "truth", "group").agg(F.avg("jaccard").alias("jaccard"))
    return ari(labels, "truth", "group").crossJoin(best).crossJoin(bridge_quality(found, true_found))


def threshold_sweep(values: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """For each threshold how many values reach it: one pass over the values."""
    counts = values.agg(*(F.count_if(F.col(column) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)))).alias("r")).select("r.*")


def bridge_sweep(counts: DataFrame, groups: int, votes: list[int], rates: list[float]) -> DataFrame:
    """How many opinions pass each pair of a least count and a least rate in all groups. The grid
    is a few constants, the counts a row an opinion and group."""
    at = counts.withColumn("grid", F.explode(F.array(*(F.struct(F.lit(v).alias("min_votes"), F.lit(r).alias("min_rate")) for v in votes for r in rates))))
    ok = (F.col("seen") >= F.col("grid.min_votes")) & (S.rate("agree", "seen") >= F.col("grid.min_rate"))
    each = at.groupBy("grid", "opinion_id").agg(F.bool_and(ok).alias("ok"), F.count("*").alias("n"))
    return each.groupBy("grid").agg(F.count_if(F.col("ok") & (F.col("n") == groups)).alias("accepted")).select("grid.min_votes", "grid.min_rate", "accepted")


def binomial_tail(sizes: DataFrame, p: float = 0.5, least_rate: float = 0.6, opinions: int = 40) -> DataFrame:
    """sizes(n): the probability that a group of that size passes a least rate by chance, that two do, and
    how many of so many opinions would. One walk over 0 to n, each term from the one before it by
    logarithms, so sizes of many thousands neither overflow nor vanish."""
    n = F.col("n")
    # multiples of the rate are compared as whole numbers of hundredths
    need = F.ceil(n * round(least_rate * 100) / 100).cast("int")
    start = F.struct((n * math.log(1 - p)).cast("double").alias("log"), F.when(need <= 0, F.exp(n * math.log(1 - p))).otherwise(0.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln((n - k + 1) / k) + math.log(p / (1 - p))
        return F.struct(log.alias("log"), F.when(k >= F.col("need"), s["sum"] + F.exp(log)).otherwise(s["sum"]).alias("sum"))

    walked = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), start, step)
    at = sizes.select("n", need.alias("need")).withColumn("one", walked["sum"])
    return at.withColumn("two", F.col("one") * F.col("one")).withColumn("expected", opinions * F.col("two"))


def first_sessions(rows: DataFrame, most: int, order: str = "session_id") -> DataFrame:
    """Rows of the first sessions in an order."""
    some = rows.select(order).distinct().orderBy(order).limit(most)
    return rows.join(some, order, "left_semi")


def minority_capped(rows: DataFrame, opinion: str, value: int, most: int = 3) -> DataFrame:
    """rows without one opinion's answers of a value beyond the first ones, by session."""
    hit = (F.col("opinion_id") == opinion) & (F.col("value") == value)
    stay = rows.where(hit).orderBy("session_id").limit(most)
    return rows.where(~hit).unionByName(stay)


def exposure(counts: DataFrame, by: str = "opinion_id", value: str = "n") -> DataFrame:
    """Least, most and mean exposure over items."""
    return counts.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def exposure_of(counts: DataFrame, items: DataFrame, by: str = "opinion_id", value: str = "n") -> DataFrame:
    """Mean exposure over some items, such as those common to all."""
    return counts.join(items.select(by), by, "left_semi").agg(F.avg(value).alias("mean"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, least and most of what is known in each group; null where nothing is."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("known"))


def eligibility_grid(votes: DataFrame, minimums: list[int], prefixes: list[int]) -> DataFrame:
    """How many of the first sessions are eligible at each least count of answers other than pass: a grid of
    constants over one row a session."""
    each = numbered(votes.groupBy("session_id").agg(F.count_if(F.col("value") != 0).alias("substantive")), ["session_id"])
    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("minimum"), F.lit(p).alias("sessions")) for m in minimums for p in prefixes))).alias("g")
    return each.select("rn", "substantive", grid).groupBy("g").agg(F.count_if((F.col("rn") <= F.col("g.sessions")) & (F.col("substantive") >= F.col("g.minimum"))).alias("eligible")).select("g.minimum", "g.sessions", "eligible")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur other than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n != 1")
