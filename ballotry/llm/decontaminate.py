"""Operator 4: benchmark decontamination as a prefix-filtered set join.

A window is `window` consecutive words of an item. Its set is its word shingles; as a
document must contain all of a window, one shingle of each window is a sufficient
prefix, and the rarest one over all documents (counted first) is taken. A document's
words are joined with these prefixes; where one occurs, its place in the window fixes
where the window would start, which must leave the whole window inside the document
(the bounds of position and length), and the words there are compared one by one.

The join's other side is the benchmark: it is read in blocks of at most BLOCK_WINDOWS
windows, each of which is one index sent to the tasks, so what is sent stays bounded
whatever the benchmark's size; a further block is a further pass over the documents
that carries the hits on. Documents are never shuffled.

Defined cases: null or wordless texts have no words and no hits; items without words
have no window, items of fewer words than a window are one window; items that repeat
an id count as one item with the windows of all its rows; a null item id counts as the
id "null"; a row of the result for each row of docs, repeated ids included; empty tables
on either side give no hits or no rows; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words of a window and of a shingle; windows of one index (each some 1 kB in Python).
WINDOW, SHINGLE, BLOCK_WINDOWS = 10, 2, 50_000

#: A-Z become a-z; what ends a word becomes a space. Bytes from 0x80 are parts of letters.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


class Index:
    """Windows of a block of items, found by one shingle each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, shingle: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, words in items:
            for at in range(max(1, len(words) - window + 1)):
                owners[tuple(words[at : at + window])].add(item)
        self.windows = [(w, sorted(ids)) for w, ids in owners.items()]
        self.shingle = shingle
        self.first: dict[bytes, dict[tuple[bytes, ...], list[tuple[int, int]]]] = {}

    def _shingles(self, words: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
        k = min(self.shingle, len(words))
        return [words[i : i + k] for i in range(len(words) - k + 1)]

    def every_shingle(self) -> dict[bytes, set[tuple[bytes, ...]]]:
        """All shingles of the windows, by their first word."""
        out: dict[bytes, set] = defaultdict(set)
        for words, _ in self.windows:
            for s in self._shingles(words):
                out[s[0]].add(s)
        return dict(out)

    def order_by(self, frequency: dict[tuple[bytes, ...], int]) -> Index:
        """Choose each window's prefix: its rarest shingle, the first of equals."""
        self.first = {}
        for n, (words, _) in enumerate(self.windows):
            found = self._shingles(words)
            at = min(range(len(found)), key=lambda i: (frequency.get(found[i], 0), found[i]))
            self.first.setdefault(found[at][0], {}).setdefault(found[at], []).append((n, at))
        return self

    def hits(self, words: list[bytes], mark: bytearray, items: set[str]) -> None:
        """Mark the words inside windows and add the items whose windows occur."""
        starts = self.first.keys() & set(words)
        if not starts:
            return
        for at, word in enumerate(words):
            if word in starts:
                for prefix, places in self.first[word].items():
                    if len(prefix) > 1 and tuple(words[at : at + len(prefix)]) != prefix:
                        continue
                    for n, offset in places:
                        window, ids = self.windows[n]
                        start = at - offset
                        if start >= 0 and start + len(window) <= len(words) and tuple(words[start : start + len(window)]) == window:
                            mark[start : start + len(window)] = b"\1" * len(window)
                            items.update(ids)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, limit: int) -> Iterator[list]:
    """Items in blocks of at most limit windows, a partition at a time on the driver. An item of
    more windows is cut into runs that overlap by a window less a word, so no window is lost."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of(row[1])
        for at in range(0, max(1, len(words) - window + 1), limit):
            part = words[at : at + limit + window - 1]
            if not part:
                continue
            n = max(1, len(part) - window + 1)
            if held + n > limit and block:
                yield block
                block, held = [], 0
            block.append(("null" if row[0] is None else row[0], part))
            held += n
    yield block


def _frequencies(docs: DataFrame, text_col: str, index: Index) -> dict[tuple[bytes, ...], int]:
    """How many times each of the index's shingles occurs in all documents; as many rows as the
    index has shingles."""
    every = index.every_shingle()
    wanted = docs.sparkSession.sparkContext.broadcast((every, sorted({len(s) for among in every.values() for s in among})))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        by_first, lengths = wanted.value
        for b in slices(batches):
            for text in b[text_col].to_pylist():
                words = words_of(text)
                starts = by_first.keys() & set(words)
                for at, word in enumerate(words):
                    if word in starts:
                        for k in lengths:
                            if (s := tuple(words[at : at + k])) in by_first[word]:
                                found[s] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["shingle", "n"])

    rows = docs.select(text_col).mapInArrow(count, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {tuple(bytes(r[0]).split(b" ")): r[1] for r in rows}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: id, n_words, n_hit (words inside an occurring window),
    n_items, items (their ids as strings, sorted), items_sha256, contaminated; and the
    columns of docs named in keep."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col), *[c for c in keep if c not in (id_col, text_col)])
    carried = [f for f in rows.schema.fields if text_col != f.name or text_col in keep]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    blocks = _blocks(benchmark, item_col, item_text, window, block_windows)
    block, later = next(blocks), False
    while block is not None:
        following = next(blocks, None)
        index = Index(block, window, shingle)
        index.order_by(_frequencies(rows, text_col, index))
        state = "hit binary, found array<string>"
        rest = "" if following is None or text_col in keep else f", `{text_col}` string"
        result = state if following is not None else "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
        rows = rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(index), text_col, [f.name for f in carried], later, following is not None, bool(rest)), f"{head}{rest}, {result}")
        block, later = following, True
    return rows


def _search(index, text_col: str, carried: list[str], resumed: bool, partial: bool, with_text: bool):  # noqa: ANN001, ANN202
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks, found, totals = [], [], []
            texts = b[text_col].to_pylist()
            before = zip(b["hit"].to_pylist(), b["found"].to_pylist(), strict=True) if resumed else ((None, ()) for _ in texts)
            for text, (mark, items) in zip(texts, before, strict=True):
                words = words_of(text)
                mark, items = bytearray(mark or len(words)), set(items)
                index.value.hits(words, mark, items)
                marks.append(mark)
                found.append(sorted(items))
                totals.append(len(words))
            out = [b[c] for c in carried] + [b[text_col]] * with_text
            names = carried + [text_col] * with_text
            if partial:
                out += [pa.array([bytes(m) for m in marks], pa.binary()), pa.array(found, pa.list_(pa.string()))]
                names += ["hit", "found"]
            else:
                hit = [sum(m) for m in marks]
                out += [pa.array(totals, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]), pa.array([h > 0 for h in hit])]
                names += ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
            yield pa.RecordBatch.from_arrays(out, names)

    return search


__all__ = ["Index", "decontaminate", "words_of"]
