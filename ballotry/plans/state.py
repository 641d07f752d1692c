"""States that change by compare-and-set, and leases on them.

A state is a numbered file in a folder. The next one is created under the next number, which only one
writer can do; what it was computed from is the number before. All of them stay, as a log.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from ..sources import files


class States:
    """States in a folder. None of them ever changes, so each is read once, and once the newest is known
    only the numbers after it are looked for: a step's cost doesn't grow with the steps before it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._read: dict[int, dict] = {}
        self._newest: int | None = None

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012}.json"

    def _state(self, number: int) -> dict | None:
        if number not in self._read and (text := files.read(self.spark, self._path(number))) is not None:
            self._read[number] = json.loads(text)
        return self._read.get(number)

    def current(self) -> dict | None:
        """The newest state, with its number; None before the first."""
        if self._newest is None:
            found = files.names(self.spark, self.folder)
            self._newest = int(found[-1].removesuffix(".json")) if found else 0
        while self._state(self._newest + 1) is not None:
            self._newest += 1
        return self._state(self._newest)

    def history(self) -> list[dict]:
        self.current()
        return [s for number in range(1, self._newest + 1) if (s := self._state(number)) is not None]

    def swap(self, expected: int, state: dict) -> dict | None:
        """state as the one after the expected number (0: the first); None where another writer
        has been there."""
        new = {**state, "number": expected + 1}
        text = json.dumps(new, sort_keys=True)
        if not files.create(self.spark, self._path(expected + 1), text):
            return None
        self._read[expected + 1] = json.loads(text)
        return new

    def acquire(self, now: int, length: int) -> dict | None:
        """Take the lease at a time in milliseconds; None while another holds it, or took it first."""
        state = self.current() or {"number": 0}
        if state.get("lease") and state["lease"]["until"] > now:
            return None
        return self.swap(state["number"], {**state, "lease": {"token": uuid.uuid4().hex, "until": now + length}})

    def finish(self, held: dict, change: dict) -> dict | None:
        """Change the state and give the lease back; None where the lease was lost meanwhile."""
        return self.swap(held["number"], {**{k: v for k, v in held.items() if k != "lease"}, **change})
