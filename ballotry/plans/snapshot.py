"""Daily snapshots: content-addressed results, a pointer, skipping unchanged input, cached reads.

The state is one small JSON document that changes by compare-and-set; results are rows of Parquet. A
run holds a lease while it computes, and moves the pointer only if it still does and if moderation
stands where it began, so that of two runs one counts and a reader sees the old or the new result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import Options, Result
from .state import States

ALGORITHM = "ballotry-analysis-1"


def configuration(options: Options) -> dict:
    return {"algorithm": ALGORITHM, "parameters": asdict(options)}


def same_configuration(stored: object, options: Options) -> bool:
    """Whether a stored configuration is this one: the same algorithm, exactly the same keys, and
    values equal in kind and value; the order of keys doesn't matter."""
    if not isinstance(stored, dict) or stored.get("algorithm") != ALGORITHM or not isinstance(stored.get("parameters"), dict):
        return False
    now, old = asdict(options), stored["parameters"]
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    return old.keys() == now.keys() and all(number(old[k]) and old[k] == v for k, v in now.items())


def civil_day(now: datetime) -> str:
    return (now.astimezone(UTC) + timedelta(hours=9)).strftime("%Y-%m-%d")


def payload(result: Result) -> str:
    """A result as JSON with sorted keys, the text whose digest names it."""
    rows = lambda df, *by: [] if df is None else [json.loads(x) for x in df.orderBy(*by).toJSON().collect()]
    return json.dumps({"status": result.status, "eligible": result.eligible, "minimum": result.minimum, "groups": result.groups, "bridges": rows(result.bridges, "opinion_id"), "explained": result.explained, "silhouette": result.silhouette}, sort_keys=True)


def head(cache: DataFrame, community: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The one row a reader needs: the cache with today's revision of moderation and, where there is one,
    its snapshot. cache(id, snapshot_id, moderation, lease_until), community(id, moderation_revision),
    snapshots(id, payload)."""
    now = community.select("id", F.col("moderation_revision").alias("current_moderation"))
    stored = snapshots.select(F.col("id").alias("snapshot_id"), "payload")
    return cache.join(now, "id").join(stored, "snapshot_id", "left")


class Store:
    """Snapshots in a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.states = spark, folder, States(spark, f"{folder}/state")

    def state(self) -> dict | None:
        """The newest state that names a snapshot, None before the first."""
        now = self.states.current()
        return now if now and "snapshot" in now else None

    def put(self, result: Result) -> str:
        """Store a result under its digest, its points beside it."""
        body = payload(result)
        name = hashlib.sha256(body.encode()).hexdigest()
        self.spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/snapshots/{name}")
        if result.points is not None:
            result.points.write.mode("overwrite").parquet(f"{self.folder}/points/{name}")
        result.release()
        return name

    def read(self, options: Options, moderation: int, known: str | None = None) -> dict:
        """The current snapshot; waiting where there is none for this configuration and state of
        moderation; a short reply where the caller has it."""
        state = self.state()
        if state is None or state["moderation"] != moderation or not same_configuration(state["configuration"], options):
            return {"status": "waiting"}
        if known == state["snapshot"]:
            return {"status": "unchanged", "snapshot": known}
        body = self.spark.read.text(f"{self.folder}/snapshots/{state['snapshot']}").first()[0]
        if hashlib.sha256(body.encode()).hexdigest() != state["snapshot"]:
            raise ValueError("the snapshot isn't what its name says")
        return {"snapshot": state["snapshot"], **json.loads(body)}


#: How long a run may hold the lease, in milliseconds.
LEASE = 16 * 60 * 1000


def run_daily(store: Store, now: datetime, revision: int, moderation: int, options: Options, compute: Callable[[], Result], still: Callable[[], int] | None = None) -> dict:
    """One run a civil day. compute() gives a Result and is called only if data, moderation or
    configuration changed since the last one. busy: another run holds the lease; superseded: the lease
    was lost, or moderation (still()) moved, while this one computed; its result isn't pointed at."""
    state, day = store.state(), civil_day(now)
    if state and state.get("day") == day:
        return {"status": "already-completed", "day": day}
    held = store.states.acquire(int(now.timestamp() * 1000), LEASE)
    if held is None:
        return {"status": "busy", "day": day}
    if held.get("day") == day:  # another run ended between the two looks
        store.states.finish(held, {})
        return {"status": "already-completed", "day": day}
    if "snapshot" in held and (held["revision"], held["moderation"]) == (revision, moderation) and same_configuration(held["configuration"], options):
        return {"status": "unchanged" if store.states.finish(held, {"day": day}) else "superseded", "day": day}
    try:
        name = store.put(compute())
    except BaseException:
        store.states.finish(held, {})
        raise
    if still is not None and still() != moderation:
        store.states.finish(held, {})
        return {"status": "superseded", "day": day}
    moved = store.states.finish(held, {"snapshot": name, "revision": revision, "moderation": moderation, "day": day, "configuration": configuration(options)})
    return {"status": "updated" if moved else "superseded", "day": day}
