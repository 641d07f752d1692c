"""Operator 2: exact deduplication by Grace hashing.

Three steps. Each scan task folds the equal texts it sees, so a group that holds a
third of all rows leaves a task as one record a chunk. The folded records are dealt
by hash; each bucket is partitioned again and again into spill files until a part
fits an open-addressing table, whose entries are equal only if their complete
contents are. The groups of two or more then go back to their rows by a join on the
digest of the text; that side is one small row a group, and Spark splits a hot key
on the other side.

Defined cases: null text is empty text; empty texts are equal to each other; a null
doc_id stays only where its group has no other; rows that repeat a doc_id and a text
all carry the same flag; an empty table gives an empty table; other columns of the
input are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Bytes of text a table may hold before its bucket is partitioned, and into how many files.
TABLE_BYTES, FAN_OUT = 48 << 20, 16
#: Bytes of distinct text a scan task folds at a time.
CHUNK_BYTES = 12 << 20


class ContentTable:
    """Open addressing with linear probing; a slot matches on the complete content."""

    def __init__(self) -> None:
        self.slots, self.entries, self.size = [-1] * 1024, [], 0

    def add(self, h: int, text: str, keep: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[0] == h and entry[1] == text:
                entry[2] = keep if entry[2] is None else entry[2] if keep is None else max(keep, entry[2])
                entry[3] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([h, text, keep, n])
        self.size += len(text) + 200
        if 3 * len(self.entries) > 2 * len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, entry in enumerate(self.entries):
            at = entry[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def grace(records: Iterable[tuple], folder: Path, limit: int = TABLE_BYTES, depth: int = 0) -> Iterator[list]:
    """Distinct contents of (hash, text, keep, n) records, folded. What doesn't fit a
    table of limit bytes is dealt by four more bits of the hash to spill files, which
    are taken one at a time. Beyond the hash's bits only equal hashes are left."""
    table, files = ContentTable(), None
    for record in records:
        if files is None:
            table.add(*record)
            if table.size > limit and depth < 15:
                files = [(folder / f"{depth}-{i}-{id(table)}").open("wb") for i in range(FAN_OUT)]
                for entry in table.entries:
                    pickle.dump(tuple(entry), files[entry[0] >> 4 * depth & 15])
                table = ContentTable()
        else:
            # what is equal to a recent record is folded before it's written
            table.add(*record)
            if table.size > limit // 8:
                for entry in table.entries:
                    pickle.dump(tuple(entry), files[entry[0] >> 4 * depth & 15])
                table = ContentTable()
    if files is None:
        yield from table.entries
        return
    for entry in table.entries:
        pickle.dump(tuple(entry), files[entry[0] >> 4 * depth & 15])
    del table
    for f in files:
        f.close()
        yield from grace(_spilled(Path(f.name)), folder, limit, depth + 1)
        Path(f.name).unlink()


def _spilled(path: Path) -> Iterator[tuple]:
    with path.open("rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in slices(batches, 512):
        yield from zip(b["h"].to_pylist(), b["text"].to_pylist(), b["keep"].to_pylist(), b["n"].to_pylist(), strict=True)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = ContentTable()
    for record in _records(batches):
        table.add(*record)
        if table.size > CHUNK_BYTES:
            yield from _batches(table.entries)
            table = ContentTable()
    yield from _batches(table.entries)


def _batches(entries: list[list]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entries), 1000):
        h, text, keep, n = zip(*entries[at : at + 1000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(text, pa.string()), pa.array(keep, pa.int64()), pa.array(n, pa.int64())], ["h", "text", "keep", "n"])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """(text_sha256, keep_id, group_size) of every text that more than one row has."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text_sha256", "keep_id", "group_size"]
        with tempfile.TemporaryDirectory() as folder:  # this task's own spill, gone when it ends
            out = []
            for _, text, keep, n in grace(_records(batches), Path(folder), limit):
                if n > 1:
                    out.append((hashlib.sha256(text.encode()).hexdigest(), keep, n))
                if len(out) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out = []
            if out:
                sha, keep, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(sha), pa.array(keep, pa.int64()), pa.array(n, pa.int64())], names)

    rows = text_or_empty(docs, id_col, text_col).select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("keep"), F.lit(1).cast("long").alias("n"))
    folded = rows.mapInArrow(_fold, "h long, text string, keep long, n long")
    return folded.repartition("h").mapInArrow(build, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """A row for each row of docs: id, keep_id (largest id with the same text),
    group_size, kept, text_sha256 of the text as it is."""
    rows = text_or_empty(docs, id_col, text_col).select(F.col(id_col), F.sha2(text_col, 256).alias("text_sha256"))
    several = groups(docs, id_col, text_col, limit)
    return rows.join(several, "text_sha256", "left").select(
        id_col,
        F.coalesce("keep_id", F.col(id_col).cast("long")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
