"""Synthetic ballots of known groups, made in parallel: every draw is a function of the seed, the
session and a counter, so any partition can make its own rows, twice alike."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPINIONS, GOLDEN_ANGLE = 40, 2.399963229728653


@dataclass(frozen=True)
class Scenario:
    """What a population is like. groups 0: no groups."""

    groups: int = 0
    answers: int = 20
    strength: float = 0.0
    weights: tuple[float, ...] = ()
    kind: str = "groups"
    passes: float = 0.08
    unrelated: float = 0.02
    uneven: bool = False
    late: bool = False


SCENARIOS = {
    "two": Scenario(2, strength=3.8), "three": Scenario(3, strength=3.8), "four": Scenario(4, strength=3.8), "weak": Scenario(3, strength=1.5),
    "minority": Scenario(2, strength=3.8, weights=(0.9, 0.1)), "minority2": Scenario(2, strength=3.8, weights=(0.98, 0.02)),
    "sparse": Scenario(3, 8, 3.8), "heterogeneous": Scenario(3, strength=3.8, uneven=True), "many_pass": Scenario(3, strength=3.8, passes=0.35),
    "random": Scenario(kind="random"), "biased": Scenario(kind="biased"), "continuous": Scenario(kind="continuous"), "continuous_line": Scenario(kind="line"),
    "uniform": Scenario(kind="uniform", passes=0.0, unrelated=0.0), "disconnected": Scenario(2, 12, 3.8, kind="disconnected"), "late": Scenario(3, strength=3.8, late=True),
}


def _draw(seed: int, k: int, *of: str) -> Column:
    """A uniform draw in [0, 1): the k-th of those of a seed and the named columns."""
    return F.xxhash64(F.lit(seed), F.lit(k), *of).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def _normal(seed: int, k: int, *of: str) -> Column:
    return F.sqrt(-2 * F.ln(F.greatest(_draw(seed, k, *of), F.lit(1e-12)))) * F.cos(2 * math.pi * _draw(seed, k + 1, *of))


def sessions(spark: SparkSession, name: str, seed: int, n: int = 1000) -> DataFrame:
    """(i, session_id, group, answers, lx, ly): exact group sizes, latent places."""
    s = SCENARIOS[name]
    step = next(p for p in (7919, 104729, 1299709) if n % p)
    weights = s.weights or (1 / max(1, s.groups),) * max(1, s.groups)
    ends = [round(n * sum(weights[: g + 1])) for g in range(len(weights) - 1)]
    place = F.pmod(F.col("id") * step + seed % n, F.lit(n))
    group = sum((F.when(place >= e, 1).otherwise(0) for e in ends), F.lit(0))
    at = spark.range(n).select(F.col("id").alias("i"), F.concat(F.lit("sim-"), F.lpad(F.col("id").cast("string"), max(4, len(str(n - 1))), "0")).alias("session_id"), group.alias("group"))
    a, b = _normal(seed, 0, "i"), _normal(seed, 2, "i")
    k = max(1, s.groups)
    x, y = {"continuous": (1.5 * a, 1.5 * b), "line": (3.8 * a, 0.1 * b)}.get(s.kind, (s.strength * F.cos(F.col("group") * 2 * math.pi / k) + 0.25 * a, s.strength * F.sin(F.col("group") * 2 * math.pi / k) + 0.25 * b))
    answers = 6 + F.pmod("i", F.lit(35)) if s.uneven else F.lit(s.answers).cast("long")
    return at.select("i", "session_id", "group", answers.alias("answers"), x.alias("lx"), y.alias("ly"))


def agreement(name: str, j: Column, x: Column, y: Column) -> Column:
    """Probability that a session at (x, y) agrees with opinion j."""
    s, shared = SCENARIOS[name], j % 5 == 2
    if s.kind in ("uniform", "random"):
        return F.lit(1.0 if s.kind == "uniform" else 0.5)
    if s.kind == "biased":
        return F.when(shared, 0.85).otherwise(0.2 + 0.15 * (j % 5))
    p = F.when(shared, 0.9).otherwise(1 / (1 + F.exp(-(F.cos(j * GOLDEN_ANGLE) * x + F.sin(j * GOLDEN_ANGLE) * y))))
    return F.when(j == OPINIONS - 1, 0.55).otherwise(p) if s.late else p


def ballots(spark: SparkSession, name: str, seed: int, n: int = 1000) -> DataFrame:
    """(session_id, opinion_id, value): each session answers its number of opinions, chosen evenly
    without replacement (the first by a random key)."""
    s = SCENARIOS[name]
    at = sessions(spark, name, seed, n).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(OPINIONS - 1))))
    if s.kind == "disconnected":
        at = at.where((F.col("group") == 0) == (F.col("j") < OPINIONS // 2))
    if s.late:
        at = at.where((F.col("j") != OPINIONS - 1) | (F.col("i") >= n - 18))
    at = at.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(_draw(seed, 4, "i", "j"), "j"))).where("rank <= answers")
    u, v = _draw(seed, 5, "i", "j"), _draw(seed, 6, "i", "j")
    value = F.when(u < s.unrelated, 2).when(u < s.unrelated + s.passes, 0).when(v < agreement(name, F.col("j"), F.col("lx"), F.col("ly")), -1).otherwise(1)
    return at.select("session_id", F.concat(F.lit("p"), F.lpad(F.col("j").cast("string"), 2, "0")).alias("opinion_id"), value.alias("value"))


def true_bridges(spark: SparkSession, name: str, seed: int, n: int = 1000) -> DataFrame:
    """(opinion_id): opinions that at least .6 of the answers of every group are expected to agree
    with; none without groups."""
    s = SCENARIOS[name]
    at = sessions(spark, name, seed, n).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(OPINIONS - 1))))
    p = at.groupBy("j", "group").agg(F.avg(agreement(name, F.col("j"), F.col("lx"), F.col("ly"))).alias("p"))
    share = (1 - s.passes - s.unrelated) / (1 - s.unrelated) if s.unrelated < 1 else 0.0
    good = p.groupBy("j").agg(F.bool_and(F.col("p") * share >= 0.6).alias("ok")).where(F.col("ok") & F.lit(s.groups > 0))
    return good.select(F.concat(F.lit("p"), F.lpad(F.col("j").cast("string"), 2, "0")).alias("opinion_id"))
