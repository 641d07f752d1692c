"""The distribution from which a session's next opinion is drawn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Approved opinions whose running sums are sent to the tasks (some 50 bytes each).
MOST_OPINIONS = 1_000_000


def distribution(candidates: DataFrame, issued: DataFrame) -> DataFrame:
    """candidates(session_id, id, tag_id, agree, disagree, pass, unrelated), issued(session_id,
    tag_id, n) -> (session_id, id, tag_id, probability), which sum to 1 in each session.

    A tag's share is a fifth spread evenly and the rest by how seldom it was issued; within a
    tag .3 is even, .4 by disagreement and .3 by how little an opinion was answered."""
    at = candidates.join(issued.select("session_id", "tag_id", F.col("n").alias("issued")), ["session_id", "tag_id"], "left").fillna(0, ["issued"])
    n = F.col("agree") + F.col("disagree")
    p = (F.col("agree") + 1) / (n + 2)
    at = at.withColumns({"d": 4 * p * (1 - p) * n / (n + 8), "u": 1 / F.sqrt(1 + n + F.col("pass") + F.col("unrelated")), "seldom": 1 / F.pow(1 + F.col("issued"), F.lit(2))})
    tag, session = Window.partitionBy("session_id", "tag_id"), Window.partitionBy("session_id")
    first = F.row_number().over(tag.orderBy("id")) == 1
    at = at.withColumns({"m": F.count("*").over(tag), "sd": F.sum("d").over(tag), "su": F.sum("u").over(tag), "first": first.cast("int")})
    at = at.withColumns({"tags": F.sum("first").over(session), "seldom_sum": F.sum(F.col("first") * F.col("seldom")).over(session)})
    share = 0.2 / F.col("tags") + 0.8 * F.col("seldom") / F.col("seldom_sum")
    even = 1 / F.col("m")
    within = 0.3 * even + 0.4 * F.when(F.col("sd") == 0, even).otherwise(F.try_divide("d", "sd")) + 0.3 * F.col("u") / F.col("su")
    return at.select("session_id", "id", "tag_id", (share * within).alias("probability"))


def draw(probabilities: DataFrame, random: Column) -> DataFrame:
    """The first opinion, by tag and id, at which the running sum exceeds a session's random
    number, else the last. random: a column of probabilities' rows, constant in a session."""
    w = Window.partitionBy("session_id").orderBy("tag_id", "id")
    at = probabilities.withColumn("r", random).withColumns({"upto": F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0)), "ord": F.row_number().over(w)})
    pick = at.groupBy("session_id").agg(F.min(F.when(F.col("r") < F.col("upto"), F.struct("ord", "id"))).alias("hit"), F.max(F.struct("ord", "id")).alias("last"))
    return pick.select("session_id", F.coalesce("hit.id", "last.id").alias("id"))


def draw_located(sessions: DataFrame, opinions: DataFrame, answers: DataFrame, issued: DataFrame, most: int = MOST_OPINIONS) -> DataFrame:
    """(session_id, id): what draw() of distribution() gives for sessions(session_id, r), without a row for
    each session and opinion. opinions(id, tag_id, author_session, agree, disagree, pass, unrelated) are
    the approved ones, answers(session_id, opinion_id), issued(session_id, tag_id, n).

    What an opinion weighs within its tag is a sum of three parts, each a part of the tag's total. So the
    running sum up to a place is that of all opinions there minus that of the session's own answers and
    posts, which are few, and the place of a draw is found by bisection. Opinions' running sums go to the
    tasks while there are at most `most` of them; beyond that the distribution is made in full."""
    rows = opinions.select("id", "tag_id", "author_session", *(F.col(c).cast("long") for c in ("agree", "disagree", "pass", "unrelated")))
    if rows.limit(most + 1).count() > most:
        left = sessions.join(rows, ~F.col("author_session").eqNullSafe(F.col("session_id"))).join(answers.select("session_id", F.col("opinion_id").alias("id")), ["session_id", "id"], "left_anti")
        return draw(distribution(left.drop("r", "author_session"), issued).join(sessions, "session_id"), F.col("r"))
    spark = sessions.sparkSession
    known = rows.toPandas().sort_values(["tag_id", "id"], ignore_index=True)
    ids, tags = known["id"].to_numpy(), sorted(known["tag_id"].unique())
    if not len(ids):
        return spark.createDataFrame([], "session_id string, id string")
    n = (known["agree"] + known["disagree"]).to_numpy(float)
    p = (known["agree"].to_numpy(float) + 1) / (n + 2)
    parts = np.stack([np.ones(len(n)), 4 * p * (1 - p) * n / (n + 8), 1 / np.sqrt(1 + n + known["pass"].to_numpy(float) + known["unrelated"].to_numpy(float)), n > 0], axis=1)
    of = known["tag_id"].map({t: i for i, t in enumerate(tags)}).to_numpy()
    begin = np.searchsorted(of, np.arange(len(tags) + 1))
    sent = spark.sparkContext.broadcast((ids, parts, np.vstack([np.zeros(4), np.cumsum(parts, axis=0)]), of, begin))
    places = spark.createDataFrame(pd.DataFrame({"id": ids, "place": np.arange(len(ids))}))
    own = rows.where("author_session is not null").select(F.col("author_session").alias("session_id"), "id")
    gone = answers.select("session_id", F.col("opinion_id").alias("id")).union(own).join(places, "id").groupBy("session_id").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    numbered = spark.createDataFrame([(t, i) for i, t in enumerate(tags)], "tag_id string, t int")
    shown = issued.join(numbered, "tag_id").groupBy("session_id").agg(F.collect_list(F.struct("t", "n")).alias("shown"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, upto, of, begin = sent.value
        size = len(begin) - 1
        total = upto[begin[1:]] - upto[begin[:-1]]
        for b in batches:
            k = len(b)
            lists = [np.asarray(g if g is not None else [], np.int64) for g in b["gone"]]
            who, where = np.repeat(np.arange(k), [len(g) for g in lists]), np.concatenate([np.empty(0, np.int64), *lists])
            less = np.zeros((k, size, 4))
            np.add.at(less, (who, of[where]), parts[where])
            gone_upto = np.vstack([np.zeros(4), np.cumsum(parts[where], axis=0)])
            left = total[None] - less
            m, some = np.rint(left[:, :, 0]), np.rint(left[:, :, 3]) > 0
            seen = np.zeros((k, size))
            for i, rows in enumerate(b["shown"]):
                for r in rows if rows is not None else ():
                    seen[i, r["t"]] = r["n"]
            there = m > 0
            seldom = np.where(there, 1 / (1 + seen) ** 2, 0.0)
            with np.errstate(invalid="ignore", divide="ignore"):
                share = np.where(there, 0.2 / there.sum(1, keepdims=True) + 0.8 * seldom / seldom.sum(1, keepdims=True), 0.0)
            edge = np.cumsum(share, axis=1)
            r = b["r"].to_numpy(float)
            hit = r[:, None] < edge
            last = size - 1 - np.argmax(there[:, ::-1], axis=1)
            t = np.where(hit.any(1), np.argmax(hit, axis=1), last)
            row = np.arange(k)
            with np.errstate(invalid="ignore", divide="ignore"):
                aim = np.where(hit.any(1), (r - (edge[row, t] - share[row, t])) / share[row, t], 1.0)
                even = 1 / m[row, t]
                by_d = np.where(some[row, t], 0.4 / left[row, t, 1], 0.0)
                weights = np.stack([0.3 * even + np.where(some[row, t], 0.0, 0.4 * even), by_d, 0.3 / left[row, t, 2]], axis=1)
            keys = who * len(ids) + where
            base = np.searchsorted(keys, row * len(ids) + begin[t])

            def running(at: np.ndarray) -> np.ndarray:  # sums of the session's own candidates from the tag's first to this place
                return upto[at + 1] - upto[begin[t]] - (gone_upto[np.searchsorted(keys, row * len(ids) + at, side="right")] - gone_upto[base])

            def first(far: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:  # the first place of the tag from which it holds
                low, high = begin[t].copy(), begin[t + 1] - 1
                while (low < high).any():
                    mid = (low + high) // 2
                    yes = far(running(mid))
                    high, low = np.where(yes, mid, high), np.where(yes, low, np.minimum(mid + 1, high))
                return low

            # beyond the draw, or all candidates passed: the last one takes what rounding leaves
            at = first(lambda sums: (np.rint(sums[:, 0]) >= 1) & (((sums[:, :3] * weights).sum(1) > aim) | (np.rint(sums[:, 0]) >= m[row, t])))
            # by count, which is exact, to a candidate: rounding may have stopped at an answer of the session's own
            own = np.isin(row * len(ids) + at, keys)
            nth = np.minimum(np.rint(running(at)[:, 0]) + own, m[row, t])
            low = first(lambda sums: np.rint(sums[:, 0]) >= nth)
            any_left = there.any(1)
            yield pd.DataFrame({"session_id": b["session_id"][any_left], "id": ids[low[any_left]]})

    at = sessions.select("session_id", F.col("r").cast("double").alias("r")).join(gone, "session_id", "left").join(shown, "session_id", "left")
    return at.mapInPandas(find, "session_id string, id string")
