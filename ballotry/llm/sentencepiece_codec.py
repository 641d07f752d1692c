"""Operator 9: offset-preserving SentencePiece encoding and decoding.

The model file is read here: its pieces, its normaliser's flags and its compiled
character map (a double-array trie). Text is normalised by the longest prefix that the
map knows, else by the character itself, and each normalised byte remembers the source
byte it came from. White space becomes the marker U+2581. No piece may contain a marker
behind another character (checked when the model is read), so merges never cross from
one word into the next marker and each marked word is segmented once; the library's
merge order does that, and a Python worker remembers the words it has seen. Pieces then
lie end to end over the normalised bytes, and the alignment projects each to a span of
bytes of the original text.

Defined cases: null text is empty, has no ids and decodes to the empty text; very long
words are words like others; repeated rows are encoded each; an empty table gives an
empty one; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

MARK = "▁"
#: Words a Python worker remembers.
KNOWN_WORDS = 250_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """The compiled character map: a double-array trie of UTF-8 prefixes, whose values are
    places in a blob of NUL-ended replacements. Its first four bytes give the trie's size."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.blob = (), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units, self.blob = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[at:] and its replacement."""
        found, place = None, 0
        unit = self.units[0]
        place ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            place ^= text[i]
            unit = self.units[place]
            if unit & 0x800000FF != text[i]:
                break
            place ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                start = self.units[place] & 0x7FFFFFFF
                found = i + 1 - at, self.blob[start : self.blob.index(0, start)]
        return found


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = f.read()
        pieces, spec = [], {}
        for number, value in _fields(model):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        mark = MARK.encode()
        kinds = [p.get(3, 1) for p in pieces]
        if any(k == 4 for k in kinds):
            raise ValueError("user-defined pieces aren't supported")
        if any(mark in p[1].lstrip(mark) and mark in p[1].decode().lstrip(MARK).encode() for p in pieces if p.get(3, 1) == 1) or not (self.escape and self.prefix):
            raise ValueError("pieces of this model cross words, or it has no marker in front")
        self.unknown = kinds.index(2)
        #: Normalised bytes each piece covers; a byte piece covers one.
        self.covers = np.array([1 if k == 6 else len(p[1]) for p, k in zip(pieces, kinds, strict=True)])
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text without its leading marker, and for each of its bytes, and its
        end, the byte of text it comes from."""
        raw = text.encode()
        if self.map.units or self.squeeze:
            out, align, i = bytearray(), [], 0
            space = b" "
            while i < len(raw):
                n, new = (self.map.units and self.map.longest(raw, i)) or (1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0), None)
                new = raw[i : i + n] if new is None else new
                if self.squeeze and (not out or out.endswith(space)):
                    new = new.lstrip(space)
                out += new
                align += [i] * len(new)
                i += n
            if self.squeeze:
                while out.endswith(space):
                    out.pop()
                    i = align.pop()
            at = np.array([*align, i])
            return out.decode().replace(MARK, " "), at if MARK.encode() not in out else at[_narrowed(bytes(out))]
        return text.replace(MARK, " "), np.arange(len(raw) + 1) if MARK not in text else _narrowed(raw)

    def words(self, text: str) -> list[str]:
        """Normalised text in parts that each follow a marker of their own; a run of spaces
        belongs to the word behind it, so its other spaces begin that part."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in re.findall(r" *[^ ]+| +", " " + text)]
        return text.split(" ")

    def learn(self, words: set[str]) -> None:
        """Segment the words not seen yet."""
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        for w, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            if not w:  # a marker with nothing behind it
                ids = [self.library.piece_to_id(MARK)]
            known[w] = tuple(ids), ",".join(map(str, ids))

    def encode(self, text: str) -> list[int]:
        text, _ = self.normalise(text)
        if not text:
            return []
        words = self.words(text)
        self.learn(set(words))
        return [i for w in words for i in self.known[w][0]]

    def spans(self, normal: str, align: np.ndarray, ids: list[int]) -> np.ndarray:
        """Bounds of the ids in the original text: id k covers the bytes from bound k to bound
        k + 1. The marker in front covers none. No ids have no bounds."""
        if not ids:
            return np.zeros(0, np.int64)
        # align is by normalised bytes with one byte a space; here markers take three
        spaces = np.frombuffer(normal.encode(), np.uint8) == 0x20
        wide = np.concatenate([np.zeros(3, np.int64), np.repeat(align[:-1], 1 + 2 * spaces), align[-1:]])
        at = np.array(ids)
        if (at == self.unknown).any():
            raise ValueError("an unknown piece has no length of its own")
        ends = self.covers[at].cumsum()
        if ends[-1] != len(wide) - 1:
            raise AssertionError("pieces don't cover the text")
        return wide[np.concatenate([[0], ends])]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _narrowed(raw: bytes) -> np.ndarray:
    """Alignment of a text whose literal markers (three bytes) become one space each."""
    keep = np.ones(len(raw) + 1, bool)
    for m in re.finditer(MARK.encode(), raw):
        keep[m.start() + 1 : m.end()] = False
    return np.flatnonzero(keep)


#: "n,n" for the bounds of most texts: the end of a span and the start of the next.
_TWICE = [f"{n},{n}" for n in range(1 << 16)]


def _decimal(bounds: np.ndarray) -> str:
    """The spans between bounds, as start:end, comma-joined."""
    if len(bounds) < 2:
        return ""
    first, *inner, last = bounds.tolist()
    known = max(inner, default=0) < len(_TWICE)
    return ":".join([str(first), *(map(_TWICE.__getitem__, inner) if known else [f"{n},{n}" for n in inner]), str(last)])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The model, read once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: The columns an encoding can have, and their types.
COLUMNS = {
    "ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string",
    "n_tokens": "long", "ids_sha256": "string", "spans_sha256": "string", "decoded_sha256": "string",
}


def encode(docs: DataFrame, model: str, columns: tuple[str, ...] = ("ids", "starts", "ends", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: the id and the asked columns, which are ids, the byte span
    of each (starts, ends), the decoded text, their number and the digests of ids (decimal,
    comma-joined), of spans (start:end, likewise) and of the decoded text. Digests are taken where the ids are made, so
    that a caller who wants these alone moves no lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in slices(batches, 64):
            texts = b[text_col].to_pylist()
            normal = [own.normalise(text) for text in texts]
            split = [own.words(t) if t else [] for t, _ in normal]
            own.learn({w for words in split for w in words})
            known, made = own.known, []
            for words in split:
                found = [known[w] for w in words]
                made.append(([i for ids, _ in found for i in ids], ",".join([s for _, s in found])))
            got = {"ids": [ids for ids, _ in made], "n_tokens": [len(ids) for ids, _ in made]}
            if {"starts", "ends", "spans_sha256"} & set(columns):
                at = [own.spans(t, align, ids) for (t, align), ids in zip(normal, got["ids"], strict=True)]
                got |= {"starts": [x[:-1] for x in at], "ends": [x[1:] for x in at]}
                if "spans_sha256" in columns:
                    got["spans_sha256"] = [hashlib.sha256(_decimal(x).encode()).hexdigest() for x in at]
            if {"decoded", "decoded_sha256"} & set(columns):
                got["decoded"] = [own.decode(ids) for ids in got["ids"]]
                got["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in got["decoded"]]
            got["ids_sha256"] = [hashlib.sha256(s.encode()).hexdigest() for _, s in made]
            kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([b[id_col], *(pa.array(got[c], kinds[COLUMNS[c]]) for c in columns)], [id_col, *columns])

    rows = text_or_empty(docs, id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns))
