"""Product codes of vectors in whole numbers: the same codes on every machine.

Components become floor(4096 x). A vector is cut into equal parts, each with a codebook of its own.
Rounds of Lloyd's algorithm assign every part to its nearest entry and replace entries by floored
means; all sums are integers, so no order of tasks changes them.

The nearest entry is found by one float32 matrix product a part. Each product of that matrix has an
error bound that follows from its length and the norms of both sides, so each distance is known to
lie in an interval. Where one entry's interval lies below all others it is the nearest. Every entry
whose interval reaches into the best one's is computed again in int64; equal distances go to the
lower index.

Defined cases: rows without a vector, or with a null, NaN or infinite component, or without the
length that most vectors have (the shorter of equals; empty ones never count) are dropped; repeated
rows are coded each; of rows of one vec_id the least by components starts a codebook entry, null is
the last vec_id; with fewer vec_ids than entries there are fewer entries; null labels are one label;
an empty table gives no rows. Components of 2^27 / 4096 or more are refused: their distances would
not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components beyond this are refused.
MOST = 1 << 27
#: Labels up to which their sums are broadcast (a few MB); more are joined by spread copies.
MOST_LABELS, COPIES = 100_000, 16
_HALF_ULP = 2.0**-24


def usable(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Of each batch, the rows whose vector is whole and finite, and those vectors' lengths."""
    for batch in batches:
        lists = batch.column(column)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(np.float64))  # nulls are NaN there
        row = np.repeat(np.arange(len(lengths)), lengths)
        ok = lengths > 0
        ok[row[bad]] = False
        yield batch.filter(pa.array(ok)), lengths[ok]


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, lengths in usable(batches, 0):
        size, n = np.unique(lengths, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], ["size", "n"])


def _whole(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, q): the components in one binary value, which is ordered as they are: big-endian,
    2^31 added."""
    for batch, lengths in usable(batches):
        at = batch.filter(pa.array(lengths == size))
        if not at.num_rows:
            continue
        q = np.floor(at.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        if np.abs(q).max() >= MOST:
            raise ValueError(f"a component of {MOST / SCALE:g} or more: distances would not fit 64 bits")
        data = (q + 2**31).astype(">u4").tobytes()
        offsets = np.arange(0, len(data) + 1, 4 * size, dtype=np.int64)
        binary = pa.Array.from_buffers(pa.large_binary(), at.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([at.column(0), at.column(2), binary], ["vec_id", "label", "q"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, size).astype(np.int64) - 2**31


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """The index of each row's nearest entry, the lowest of equals, and how many distances had to be
    computed again. Compared is |c|^2 - 2 x.c, which differs from the squared distance by |x|^2 alone.

    The bound: a float32 product of w terms in any order, of operands that were rounded themselves,
    differs from the true one by at most g |x||c|, where g = (w + 2) u / (1 - (w + 2) u), u = 2^-24.
    Norms and differences in float64 are off by far less than the part in 10^6 that is added."""
    w = x.shape[1]
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    xn = np.sqrt((x * x).sum(1).astype(np.float64))
    cc = (entries * entries).sum(1).astype(np.float64)
    g = (w + 2) * _HALF_ULP / (1 - (w + 2) * _HALF_ULP)
    score = cc - 2 * product
    width = (2 * g * xn[:, None] * np.sqrt(cc)) * (1 + 1e-6) + (cc + np.abs(2 * product)) * 2.0**-50 + 2.0**-50
    open_ = score - width <= (score + width).min(1)[:, None]
    best = np.argmax(open_, axis=1)
    again = np.flatnonzero(open_.sum(1) > 1)
    if not len(again):
        return best, 0
    r, j = np.nonzero(open_[again])
    off = x[again[r]] - entries[j]
    exact = np.full((len(again), len(entries)), np.iinfo(np.int64).max)
    exact[r, j] = (off * off).sum(1)
    best[again] = exact.argmin(1)  # the first of equals
    return best, len(r)


def _sums(batches: Iterable[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, place, total, n) of one task: what its parts add to each entry's mean."""
    parts, entries, w = books.shape
    total, n = np.zeros((parts, entries, w), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        q = _matrix(batch.column(0), parts * w)
        for p in range(parts):
            x = q[:, p * w : (p + 1) * w]
            best, _ = nearest(x, books[p])
            one = np.zeros((len(x), entries), np.int64)
            one[np.arange(len(x)), best] = 1
            total[p] += one.T @ x
            n[p] += one.sum(0)
    p, e, k = (a.ravel() for a in np.indices(total.shape))
    used = n[p, e] > 0
    yield pa.RecordBatch.from_arrays([pa.array(a[used].astype(t)) for a, t in ((p, np.int32), (e, np.int32), (k, np.int32), (total.ravel(), np.int64), (n[p, e], np.int64))], ["part", "entry", "place", "total", "n"])


def _codes(batches: Iterable[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, w = books.shape
    for batch in batches:
        if not batch.num_rows:
            continue
        q, error, codes = _matrix(batch.column(2), parts * w), np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, parts), np.uint8)
        for p in range(parts):
            x = q[:, p * w : (p + 1) * w]
            codes[:, p], _ = nearest(x, books[p])
            off = x - books[p][codes[:, p]]
            error += (off * off).sum(1)
        text = codes.tobytes().hex()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error)], ["vec_id", "label", "code", "error"])


def codebooks(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, place): the codebooks after so many rounds. What comes to the driver is the
    codebooks' own size; each round is one pass over the rows."""
    ids = [r["vec_id"] for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    some = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    given = {r["vec_id"]: r["q"] for r in rows.where(some).groupBy("vec_id").agg(F.min("q").alias("q")).collect()}
    books = _matrix(pa.array([given[i] for i in ids], pa.binary()), size).reshape(len(ids), parts, size // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if ids else 0):
        sums = rows.select("q").mapInArrow(lambda b, books=books: _sums(b, books), "part int, entry int, place int, total long, n long")
        for p, e, k, total, n in sums.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect():
            books[p, e, k] = total // n
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, most_labels: int = MOST_LABELS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each usable row of
    (vec_id, embedding, label)."""
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256, two hexadecimal digits each")
    rows = vectors.select("vec_id", "embedding", "label")
    sizes = rows.select("embedding").mapInArrow(_lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    size = int(most["size"]) if most else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    kinds = dict(rows.dtypes)
    whole = cut(rows.mapInArrow(lambda b: _whole(b, size), f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary"))
    books = codebooks(whole, size, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = cut(whole.select("vec_id", "label", "q").mapInArrow(lambda b: _codes(b, books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = lambda df: df.withColumns({"no_label": F.col("label").isNull(), "label_key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    if sums.count() <= most_labels:
        out = same(coded).join(F.broadcast(same(sums).drop("label")), ["no_label", "label_key"])
    else:
        spread = same(sums).drop("label").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        out = same(coded).withColumn("copy", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(COPIES)).cast("int")).join(spread, ["no_label", "label_key", "copy"])
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
