"""Operator 3: training-order materialisation of token sequences.

Documents become token ids, each followed by the end id, and the ids of a scan partition
are packed into sequences of a fixed length (the last one padded). They are encoded once and
kept as a compressed table until all shards are written. Counts of that table, one small row a
partition, and their running sums number all sequences from 0 to N - 1 without a sort or a
shuffle. A keyed Feistel network over the next even power of two, walked until it falls below
N, permutes 0 .. N - 1; a sequence's image is its global slot, and inverse() leads back.
Sequences are dealt by ranges of slots, the shards, in PASSES passes over the kept table, each
for its share of the shards, so that only a part of the shuffle lies beside the kept table and
the shards. A task sorts its shards by slot (Spark's sort, which spills) and writes each as one file of
records of fixed stride, so the record of any slot is at a place that arithmetic gives, and a
reader can go on from where it stopped.

docs is read once, so its rows needn't come out in the same partitions again. Shards are written
under another name and moved into place, so a task that runs again replaces the same file.

Defined cases: null or empty text is the end id alone; repeated rows are encoded each; an
empty table writes no shard; very long texts span many sequences; other columns aren't
looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotry.sources.files import delete

from .common import cut, filesystem, new_folder, release, slices

#: Ids of a sequence, sequences of a shard, the id behind each document and the one that pads.
LENGTH, PER_SHARD, END, PAD = 1024, 4096, 50256, 65535
ROUNDS = 6
#: Tasks that write shards at most; beyond that a task writes several.
MAX_TASKS = 50_000
#: Passes that deal the kept sequences: a pass shuffles this part of them.
PASSES = 4
U = np.uint64


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: str) -> None:
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = [int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        x = (x ^ U(key)) * U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return (x ^ (x >> U(29))) & U((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        left, right = x >> U(self.half), x & U((1 << self.half) - 1)
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        # the halves change places, so that the reversed keys undo all rounds
        return right << U(self.half) | left

    def _walk(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        x = np.array(x, U)
        out = self._once(x, keys)
        while len(over := np.flatnonzero(out >= U(self.n))):
            out[over] = self._once(out[over], keys)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def inverse(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


_encodings: dict[str, object] = {}


def encoding(path: str):  # noqa: ANN201
    """A byte-level encoding from a file of ranks, read once in each Python worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def sequences(rows: DataFrame, ranks: str, length: int) -> DataFrame:
    """(part, at, ids): the sequences of each scan partition from 0; ids are length little-endian 16-bit values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, end = encoding(ranks), TaskContext.get().partitionId(), np.array([END], "<u2")
        made, held, size = 0, [], 0

        def give(stream: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            k = -(-len(stream) // length)
            full = np.full(k * length, PAD, "<u2")
            full[: len(stream)] = stream
            made += k
            ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), k, [None, pa.py_buffer(full)]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, part, np.int32)), pa.array(np.arange(made - k, made)), ids], ["part", "at", "ids"])

        for b in slices(batches, 64):
            for text in b["text"].to_pylist():
                ids = own.encode_ordinary(text)
                held += (np.array(ids, "<u2"), end)
                size += len(ids) + 1
                if size >= 256 * length:
                    stream = np.concatenate(held)
                    whole = size - size % length
                    yield give(stream[:whole])
                    held, size = [stream[whole:]], size - whole
        if size:
            yield give(np.concatenate(held))

    return rows.mapInArrow(run, "part int, at long, ids binary")


def dealt(kept: DataFrame, first: dict[int, int], order: Feistel, per_shard: int, shards: range) -> DataFrame:
    """(shard, slot, ids) of the kept sequences(part, at, ids) whose shard is in a range. first: the
    number of each partition's first sequence."""
    known = kept.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, inverse = np.unique(b["part"].to_numpy(), return_inverse=True)
            slots = order.slot(np.array([known.value[p] for p in parts.tolist()], np.int64)[inverse] + b["at"].to_numpy())
            shard = slots // per_shard
            here = np.flatnonzero((shard >= shards.start) & (shard < shards.stop))
            for i in range(0, len(here), 256):
                some = here[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(shard[some].astype(np.int32)), pa.array(slots[some]), b["ids"].take(pa.array(some))], ["shard", "slot", "ids"])

    return kept.mapInArrow(run, "shard int, slot long, ids binary")


def write(found: DataFrame, folder: str, length: int, shards: int) -> DataFrame:
    """Write (shard, slot, ids) as files of fixed stride; (shard, path, first_slot, records, sha256)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task, now, out, made = TaskContext.get().taskAttemptId(), None, None, []

        def close() -> None:
            out.close()
            path = f"{root}/shard-{now:08d}.bin"
            if fs.get_file_info(path).type != 0:
                fs.delete_file(path)
            fs.move(f"{root}/.task-{task}-{now}", path)
            made.append((now, f"{folder}/shard-{now:08d}.bin", first, records, digest.hexdigest()))

        for b in slices(batches, 512):
            for shard, slot, ids in zip(*(b[c].to_pylist() for c in ("shard", "slot", "ids")), strict=True):
                if shard != now:
                    if now is not None:
                        close()
                    now, first, records, digest = shard, slot, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{root}/.task-{task}-{now}", compression=None)
                if slot != first + records or len(ids) != 2 * length:
                    raise RuntimeError(f"slot {slot} doesn't follow in shard {shard}")
                out.write(ids)
                digest.update(ids)
                records += 1
        if now is not None:
            close()
        shard, path, start, n, sha = zip(*made, strict=True) if made else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(path, pa.string()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["shard", "path", "first_slot", "records", "sha256"])

    ranges = found.repartition(max(1, min(shards, MAX_TASKS)), "shard").sortWithinPartitions("shard", "slot")
    return cut(ranges.mapInArrow(run, "shard int, path string, first_slot long, records long, sha256 string"))


def materialise(docs: DataFrame, ranks: str, key: str = "0", length: int = LENGTH, per_shard: int = PER_SHARD, folder: str | None = None, text_col: str = "text") -> DataFrame:
    """Write docs in training order to shards in folder (a new shared one unless given); the
    manifest: shard, path, first_slot, records, sha256."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    folder, aside = folder or new_folder(spark, "shards"), new_folder(spark, "sequences")
    try:
        # ids hardly repeat, so a dictionary would only cost time
        sequences(rows, ranks, length).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(aside)
        kept, first, total = spark.read.parquet(aside), {}, 0
        for part, n in sorted(tuple(r) for r in kept.groupBy("part").count().collect()):
            first[part] = total
            total += n
        shards, order, made = -(-total // per_shard), Feistel(total, key), []
        share = max(1, -(-shards // PASSES))
        for at in range(0, max(1, shards), share):
            some = range(at, min(at + share, shards))
            made.append(write(dealt(kept, first, order, per_shard, some), folder, length, len(some)))
            release(spark)  # the shuffle of this pass
    finally:
        delete(spark, aside)
    return reduce(DataFrame.union, made)


def read(manifest: DataFrame, length: int = LENGTH, from_slot: int = 0, with_ids: bool = True) -> DataFrame:
    """The sequences from a slot on: slot, shard, byte_offset, n_tokens, ids_sha256 (of the
    record), ids (null unless with_ids). A task reads a shard in order, beginning at from_slot."""
    stride = 2 * length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, first, records in zip(*(b[c].to_pylist() for c in ("shard", "path", "first_slot", "records")), strict=True):
                skip = min(records, max(0, from_slot - first))
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    f.seek(skip * stride)
                    while skip < records:
                        n = min(512, records - skip)
                        raw = f.read(n * stride)
                        if len(raw) != n * stride:
                            raise ValueError(f"{path} is cut off")
                        ids = np.frombuffer(raw, "<u2").reshape(n, length)
                        parts = [raw[i * stride : (i + 1) * stride] for i in range(n)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(first + skip, first + skip + n)), pa.array([shard] * n, pa.int32()), pa.array(np.arange(skip, skip + n) * stride), pa.array((ids != PAD).sum(axis=1)), pa.array([hashlib.sha256(p).hexdigest() for p in parts]), pa.array(ids.tolist() if with_ids else [None] * n, pa.list_(pa.int32()))],
                            ["slot", "shard", "byte_offset", "n_tokens", "ids_sha256", "ids"],
                        )
                        skip += n

    few = manifest.where(F.col("first_slot") + F.col("records") > from_slot)
    return few.repartition(max(1, few.count())).mapInArrow(run, "slot long, shard int, byte_offset long, n_tokens long, ids_sha256 string, ids array<int>")
