"""Phrase collocations: which words stand together more often than apart, by language.

A task cuts its texts into shards of bounded size. In a shard words are numbers, and a suffix
array over them, built by prefix doubling, brings equal phrases together: neighbours whose common
prefix has m words or more are an interval, one phrase of m words, and the interval's length is
its count. Shards' counts are summed by phrase.

Nearly all phrases are rare, so most keys would be shuffled for nothing. Passes before the last
therefore sum interval lengths by a hash of the phrase, which a shard sends as sorted differences
under a byte or two each, into as many buckets as grow with the input. A phrase can only be frequent
if its bucket is, and if both phrases one word shorter within it are. The last pass sums phrases
themselves, of those places alone that a bitmap of frequent buckets leaves, and drops what is below
the least count: buckets and bitmap spare rows, and results don't depend on their sizes.

Defined cases: null text counts as empty and has no words; null lang is "und"; a repeated row
counts each time; doc_id and other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: UTF-8 bytes of texts whose words share a suffix array (one longer text is a shard alone).
SHARD_BYTES = 16 << 20
#: Buckets that one task sums at a time (a byte each); ranges of so many for each input partition.
RANGE_BITS, RANGES_EACH = 23, 2
#: Bits of the bitmap of frequent buckets, at most (16 MB) and for each bucket.
MOST_BITS, BITS_EACH = 1 << 27, 32
#: Parts into which a language's rows are dealt before its first ones are chosen.
PARTS = 32
#: Copies of a word's count, over which the candidates that it is a part of are spread.
COPIES = 4

_WORD, _BLANK, _STOP = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _STOP
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_DDL = "lang string, phrase string, f long"


def tokenise(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the text each is from, and how many words are left in its piece,
    itself included. Texts and pieces end at ASCII bytes, so bytes can stand for characters."""
    data = np.frombuffer(b"\n".join([*texts, b""]).translate(_LOWER), np.uint8)
    kind = _KIND[data]
    within = kind == _WORD
    edge = np.diff(within.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    del edge
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[within])])
    stops = np.searchsorted(np.flatnonzero(kind == _STOP), starts)
    last = np.flatnonzero(np.append(stops[1:] != stops[:-1], n > 0)[:n])
    left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(n) + 1
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return words, np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0)), left


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the next depth words (at least) of their piece: each round of prefix
    doubling orders by twice as many as the one before, on pairs of its ranks."""
    rank, have = ids.astype(np.int64) + 1, 1
    while True:
        key = rank
        if have < depth:
            after = np.zeros(len(rank), np.int64)
            after[:-have] = rank[have:]
            key = rank * (int(rank.max(initial=0)) + 1) + np.where(left > have, after, 0)
            have *= 2
        order = np.argsort(key)
        if have >= depth:
            return order
        at = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.diff(at, prepend=-1) != 0)


def intervals(ids: np.ndarray, left: np.ndarray, order: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A position of each phrase of m words, and how often it occurs: the intervals of the suffix
    array in which neighbours have m words in common."""
    a, b, n = order[:-1], order[1:], len(ids)
    alike = (left[a] >= m) & (left[b] >= m)
    for j in range(m):
        alike &= ids[np.minimum(a + j, n - 1)] == ids[np.minimum(b + j, n - 1)]
    begins = np.flatnonzero(np.append(True, ~alike)[:n])
    counts = np.diff(begins, append=n)
    whole = left[order[begins]] >= m
    return order[begins[whole]], counts[whole]


def _hashes(names: pa.Array, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x, seed) for x in names.cast(pa.binary()).to_pylist()], np.uint64)


class Shard:
    """Texts as word numbers: word and lang of each place, how many words its piece has left, and the
    hashes of both."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        words, text, self.left = tokenise(texts)
        coded = words.dictionary_encode()
        self.word, self.names = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())
        spoken = pa.array(langs, pa.string()).dictionary_encode()
        self.lang, self.langs = spoken.indices.to_numpy()[text].astype(np.int32), spoken.dictionary
        self.word_hash, self.lang_hash = _hashes(self.names, 2), _hashes(self.langs, 1)

    def ids(self, at: np.ndarray | slice) -> np.ndarray:
        """Numbers of the words at these places, different for each language."""
        if len(self.langs) == 1:
            return self.word[at]
        return pa.array(self.lang[at].astype(np.int64) * len(self.names) + self.word[at]).dictionary_encode().indices.to_numpy()

    def hashed(self, at: np.ndarray, m: int) -> np.ndarray:
        """64-bit hashes of the phrases of m words that begin at these places."""
        h = self.lang_hash[self.lang[at]] + np.uint64(m)
        for j in range(m):
            h = (h ^ self.word_hash[self.word[np.minimum(at + j, len(self.word) - 1)]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def phrases(self, at: np.ndarray, m: int) -> pa.Array:
        parts = [self.names.take(pa.array(self.word[at + j])) for j in range(m)]
        return (pc.binary_join_element_wise(*parts, b" ") if m > 1 else parts[0]).cast(pa.string())

    def counted(self, m: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each phrase of m words that begins at some of the given places, and how many of
        them it begins at: a suffix array over those places and the words they reach."""
        needed = np.zeros(len(self.word), bool)
        for j in range(m):
            needed[j:] |= begins[: len(begins) - j]
        at = np.flatnonzero(needed)
        left, ids = np.where(begins[at], np.minimum(self.left[at], m), 0), self.ids(at)
        # ranks of places that don't begin a phrase are of their word alone, which the order of m words allows
        p, f = intervals(ids, left, suffix_array(ids, left, m), m)
        return at[p], f


class Frequent:
    """Which phrases of so many words may be frequent: those whose bucket's bit is set in a bitmap."""

    def __init__(self, size: int, bitmap: Broadcast) -> None:
        self.size, self.bitmap = size, bitmap

    def at(self, shard: Shard, m: int) -> np.ndarray:
        """For each place of a shard whether the phrase of m words that begins there may be frequent."""
        out = shard.left >= m
        places = np.flatnonzero(out)
        bit = (shard.hashed(places, m) & np.uint64(self.size - 1)).astype(np.int64)
        out[places] = (np.frombuffer(self.bitmap.value, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return out


def _bucketed(shard: Shard, lengths: list[int], shorter: Frequent | None, least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(range, data): the counts of a shard's phrases by bucket, up to least, range by range."""
    hashes, counts = [], []
    if shorter is None:
        ids = shard.ids(slice(None))
        order = suffix_array(ids, shard.left, max(lengths))
        found = [(m, *intervals(ids, shard.left, order, m)) for m in lengths]
    else:
        found = []
        for m in lengths:
            ok = shorter.at(shard, m - 1)
            begins = (shard.left >= m) & ok
            begins[:-1] &= ok[1:]
            found.append((m, *shard.counted(m, begins)))
    for m, at, f in found:
        hashes.append(shard.hashed(at, m) & np.uint64((1 << bits) - 1)), counts.append(np.minimum(f, least))
    bucket, count = np.concatenate(hashes).astype(np.int64), np.concatenate(counts)
    order = np.argsort(bucket)
    bucket, count = bucket[order], count[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    if not len(first):
        return
    bucket, count = bucket[first], np.minimum(np.add.reduceat(count, first), least).astype(np.uint8)
    part = bucket >> RANGE_BITS
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    low, ends = (bucket & ((1 << RANGE_BITS) - 1)).astype("<u4"), np.append(cuts[1:], len(part))
    codec = pa.Codec("zstd", 1)
    # differences by byte, then counts; the length first
    data = [len(d := np.diff(low[i:j], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)).to_bytes(4, "little") + codec.compress(d.T.tobytes() + count[i:j].tobytes(), asbytes=True) for i, j in zip(cuts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(data, pa.binary())], ["range", "data"])


def _summed(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Buckets that reach least, from data in the order of ranges: a byte for each bucket of a range."""
    codec, now, total = pa.Codec("zstd"), -1, np.zeros(1 << RANGE_BITS, np.uint8)

    def full() -> pa.RecordBatch:
        at = np.flatnonzero(total >= least) + (now << RANGE_BITS)
        return pa.RecordBatch.from_arrays([pa.array(at)], ["bucket"])

    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != now:
                if now >= 0:
                    yield full()
                now = part
                total[:] = 0
            raw = data.as_buffer()
            n = int.from_bytes(raw[:4].to_pybytes(), "little")
            flat = np.frombuffer(codec.decompress(raw[4:], decompressed_size=5 * n), np.uint8)
            at = np.cumsum(np.ascontiguousarray(flat[: 4 * n].reshape(4, n).T).view("<u4").ravel())
            total[at] = np.minimum(total[at].astype(np.uint16) + flat[4 * n :], least)
    if now >= 0:
        yield full()


def _phrases(shard: Shard, frequent: dict[int, Frequent]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of a shard's phrases that may be frequent, and the words of each language in
    all, as the empty phrase."""
    total = np.bincount(shard.lang, minlength=len(shard.langs))
    yield pa.RecordBatch.from_arrays([shard.langs, pa.array([""] * len(total)), pa.array(total)], schema=_SCHEMA)
    for m, bitmap in frequent.items():
        at, counts = shard.counted(m, bitmap.at(shard, m))
        for i in range(0, len(at), 1 << 16):
            p, f = at[i : i + (1 << 16)], counts[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([shard.langs.take(pa.array(shard.lang[p])), shard.phrases(p, m), pa.array(f)], schema=_SCHEMA)


def _each_shard(batches: Iterable[pa.RecordBatch], work: Callable[[Shard], Iterator[pa.RecordBatch]], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """work on shards of the texts of (lang, text)."""

    def done() -> Iterator[pa.RecordBatch]:
        shard = Shard(texts, langs)
        texts.clear(), langs.clear()
        if len(shard.word):
            yield from work(shard)

    texts, langs, size = [], [], 0
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if size and size + len(text) > shard_bytes:
                yield from done()
                size = 0
            texts.append(text), langs.append(lang)
            size += len(text) + 1
    yield from done()


def _bitmap(buckets: DataFrame, most_bits: int) -> Frequent:
    """The bitmap of buckets. Spark ors the bits; the driver gathers at most most_bits of them,
    32,768 a row."""
    size = min(most_bits, 1 << max(15, (BITS_EACH * buckets.count() - 1).bit_length()))
    bit = F.col("bucket").bitwiseAND(F.lit(size - 1)) + 1
    rows = buckets.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("b"))
    bitmap = bytearray(size // 8)
    for k, b in rows.toLocalIterator():
        bitmap[(k - 1) * 4096 : k * 4096] = b
    return Frequent(size, buckets.sparkSession.sparkContext.broadcast(bytes(bitmap)))


def counts(docs: DataFrame, most: int = 3, least: int = 10, shard_bytes: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, phrase, f) of the phrases of one word to most words that occur least times or more in
    their language, in the whole table, and each language's words in all, as the empty phrase.
    A shard gives a phrase once, so rows are dealt by phrase before they are summed and no key
    has more rows than there are shards."""
    if most < 2 or not 1 <= least <= 255:
        raise ValueError("most: 2 or more; least: 1 to 255")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = RANGES_EACH * texts.rdd.getNumPartitions()
    bits = RANGE_BITS + (ranges - 1).bit_length()
    frequent: dict[int, Frequent] = {}
    for lengths in ([1, 2], *([m] for m in range(3, most + 1))):
        shorter = frequent.get(lengths[0] - 1)
        send = lambda s, lengths=lengths, shorter=shorter: _bucketed(s, lengths, shorter, least, bits)
        data = texts.mapInArrow(lambda b, send=send: _each_shard(b, send, shard_bytes), "range long, data binary")
        full = cut(data.repartition("range").sortWithinPartitions("range").mapInArrow(lambda b: _summed(b, least), "bucket long"))
        frequent |= dict.fromkeys(lengths, _bitmap(full, most_bits))
    rows = texts.mapInArrow(lambda b: _each_shard(b, lambda s: _phrases(s, frequent), shard_bytes), _DDL)
    return cut(rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")))


def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, covered: int = 50, shard_bytes: int = SHARD_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to most words.

    A phrase of a occurrences cut after k words has l and r, its parts' counts, and scores
    1,000,000 a a / (l r), floored, in decimals of 38 digits; its lowest cut counts, the earliest of
    equals. A phrase goes if a longer candidate holds it with covered per cent of its count or
    more. Order: score, count, phrase (bytes)."""
    known = counts(docs, most, least, shard_bytes, most_bits)
    candidates = known.where("phrase like '% %'").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    said = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    size = F.size("w")
    longer = candidates.where(size > 2).select(
        "lang", "a", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < covered * F.col("a")))
    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("lang", "phrase", "a", "k", said(F.lit(1), F.col("k")).alias("first"), said(F.col("k") + 1, size).alias("rest"))
    copy = lambda part: F.when(F.col(part).contains(" "), 0).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(COPIES)).cast("int"))
    cuts = cuts.withColumns({"copy": copy("first"), "copy_r": copy("rest")})
    parts = known.where("phrase <> ''").withColumn("copy", F.explode(F.when(F.col("phrase").contains(" "), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(COPIES - 1)))))
    part = lambda name, f: parts.select("lang", "copy", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "copy", "first"]).join(part("rest", "r").withColumnRenamed("copy", "copy_r"), ["lang", "copy_r", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumn("score", F.call_function("div", (wide("a") * wide("a")).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = known.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
