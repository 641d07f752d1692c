"""Operator 10: near-duplicate documents by fast similarity sketching.

Each document's word-shingle set is sketched in rounds of hashed bin placement: in
round i < t every element falls into a random bin, in round t + i all fall into bin
i, and a bin keeps the smallest (round, hash) it ever saw. So all t coordinates fill,
two sets agree in a coordinate with probability their Jaccard similarity, and the
agreement count is as concentrated as with t independent functions, at the cost of
about one pass (Dahlgaard, Knudsen, Thorup 2017). Bands of the sketch give buckets.

Of a bucket every member is tested against the smallest and the largest member. What
is linked is joined by distributed union-find, what is at least loosely similar makes
families. In a family that links leave in several components, the members outside the
largest are tested against all, and so are members that are close to neither end of a
bucket among themselves: in blocks of bounded size that count all common shingles at
once and give out a spanning forest of the links, never the pairs (graph.blocks). A
pair is linked only after its full shingle sets are compared. Equal sets are one node
throughout, so copies cost nothing.

Defined cases: null or blank text has no shingles and is linked with nothing; a text
of fewer words than a shingle has one shingle, the whole sequence; a null doc_id is
linked with nothing and is its own (null) component; rows that repeat a doc_id count
as one document; an empty table gives an empty one; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_or_empty
from .graph import blocks, components, crowded, orphans, stars, unsettled

#: Bands and coordinates in a band. A pair at similarity 0.8 shares no bucket with
#: probability (1 - 0.8 ** 4) ** 25, two in a million.
BANDS, ROWS = 25, 4
#: Words whose hash a Python worker remembers.
KNOWN_WORDS = 300_000

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct word-shingle hashes (sorted, 64 bits) of a text."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.encode().lower().split()  # on bytes: A-Z alone, ASCII white space alone
        if not tokens:
            return np.empty(0, U)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(tokens):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, tokens), U, len(tokens))
        k = min(self.words, len(h))
        out = mix(h[: len(h) - k + 1] + U(k))
        for i in range(1, k):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each set; an empty set's are all ones."""
    unset = np.iinfo(np.uint64).max
    out = np.full(len(sets) * t, unset, U)
    sizes = np.array([len(s) for s in sets])
    base, x = np.repeat(np.arange(len(sets)) * t, sizes), np.concatenate([*sets, np.empty(0, U)])
    open_ = sizes > 0
    for i in range(2 * t):
        h = mix(x + U((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> U(40)) % U(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, base + bins, (U(i) << U(40)) | (h & U(0xFFFFFFFFFF)))
        if i < 6 or i % 5 == 0 or i >= t:
            now = open_ & (out.reshape(-1, t) == unset).any(axis=1)
            if not now.any():
                break
            if now.sum() < open_.sum():
                here = np.repeat(now[open_], sizes[open_])
                base, x, open_ = base[here], x[here], now
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2])
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def sketch_rows(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, print, keys): set size, a fingerprint of the set, bucket keys."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for b in slices(batches, 200):
            sets = [shingle(t) for t in b[text_col].to_pylist()]
            keys = band_keys(sketches(sets, bands * rows), bands, rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            prints = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b[id_col].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), prints, flat], [id_col, "n_shingles", "print", "keys"])

    return text_or_empty(docs, id_col, text_col).mapInArrow(build, f"{id_col} long, n_shingles long, print binary, keys array<long>")


def compared(edges: DataFrame, texts: DataFrame, words: int, threshold: int, loose: int) -> DataFrame:
    """(a, b, linked) of those edges(a, b) whose full sets have 100 * |a & b| >= loose *
    |a | b|; linked: also >= threshold * |a | b|. texts: (node, text). The few nodes at the end
    of very many edges make hot keys on the edges' side of a join, which Spark splits."""

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, left, right = Shingler(words), None, None, {}
        for b in slices(batches, 200):
            ok, strong = [], []
            for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True):
                if x != last:
                    last, left = x, shingle(x)
                if (other := right.get(y)) is None:
                    if len(right) >= 32:
                        right.clear()
                    other = right[y] = shingle(y)
                common = 100 * len(np.intersect1d(left, other, assume_unique=True))
                union = len(left) + len(other) - common // 100
                ok.append(common >= loose * union)
                if ok[-1]:
                    strong.append(common >= threshold * union)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep), pa.array(strong, pa.bool_())], ["a", "b", "linked"])

    one = edges.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return two.mapInArrow(test, "a long, b long, linked boolean")


def block_links(groups: DataFrame, texts: DataFrame, shingler: Callable[[], Callable[[str], np.ndarray]], threshold: int) -> DataFrame:
    """A spanning forest (a, b) of the links between components of groups(group, node,
    component, stray), each of its edges verified on the full sets that a shingler gives."""

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, key, strays, index, up, found = shingler(), None, [], None, {}, []

        def root(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        for b in slices(batches, 200):
            for *at, stray, c, text in zip(*(b[n].to_pylist() for n in ("group", "block", "chunk", "stray", "component", "text")), strict=True):
                if at != key:
                    key, strays, index, up = at, [], None, {}
                s = shingle(text)
                if stray:
                    strays.append((c, s))
                    continue
                if not strays:
                    continue
                if index is None:
                    owner = np.repeat(np.arange(len(strays)), [len(x) for _, x in strays])
                    every = np.concatenate([x for _, x in strays])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], np.array([len(x) for _, x in strays])
                low, high = np.searchsorted(index[0], s, "left"), np.searchsorted(index[0], s, "right")
                n = high - low
                hits = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(index[1][hits], minlength=len(strays))
                for i in np.flatnonzero(100 * common >= threshold * (index[2] + len(s) - common)):
                    x, y = root(strays[i][0]), root(c)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        found.append((strays[i][0], c))
            if found:
                x, y = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
                found = []

    return blocks(groups.join(texts, "node")).mapInArrow(test, "a long, b long")


def near_dedup(docs: DataFrame, words: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (smallest id that links
    of at least threshold per cent Jaccard similarity reach), kept (id = component_id)."""
    sets = cut(sketch_rows(docs, words, bands, rows, id_col, text_col))
    full = sets.where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    # equal sets are one node, named by its smallest id; keys are a function of the print
    nodes = cut(full.groupBy("print", "keys").agg(F.min(id_col).alias("node")))
    members = cut(crowded(nodes.select("node", F.explode("keys").alias("key"))))
    texts = text_or_empty(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    texts = cut(texts.join(members.select("node").distinct(), "node", "left_semi"))
    near = cut(compared(stars(members), texts, words, threshold, threshold // 2))
    links = near.where("linked").select("a", "b")
    alone = orphans(members, near).select(F.col("key").alias("group"), "node", F.col("node").alias("component"), "stray")
    more = cut(block_links(unsettled(near, links).union(alone), texts, lambda: Shingler(words), threshold))
    found = components(links.union(more))
    # nodes that share an id (a repeated doc_id) are one node already; label the prints, then the rows
    labels = nodes.select("print", "node").join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    several = labels.join(full.groupBy("print").agg(F.count("*").alias("n"), F.max(id_col).alias("high")), "print").where("n > 1 or component_id != high")
    out = sets.join(several.select("print", "component_id"), "print", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col(id_col).isNotNull(), F.coalesce("component_id", id_col)).otherwise(F.col(id_col))
    return out.select(id_col, "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def miss_rate(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that a pair of that similarity shares no bucket."""
    return math.pow(1 - similarity**rows, bands)
