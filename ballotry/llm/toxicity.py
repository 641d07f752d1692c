"""Operator 7: toxicity by a string-kernel support vector machine with Nyström landmarks.

Kernel of two words: the gap-weighted subsequence kernel on three characters (each common
subsequence counts DECAY to the length it spans, within SPAN characters), normalised and
raised to a power; what stays under FLOOR counts as nothing. An insult with letters put in
between, or built on a known stem, keeps most of its subsequences. Kernel of two sentences:
the sum over their words. Landmarks are words of labelled sentences; the Nyström map of a
sentence is K_mm^-1/2 times its kernel values with them, and a squared-hinge SVM is trained
in that space by Newton steps. Labels are by document, so the sentence that speaks most for
a toxic document is its positive example (chosen anew after each training); all sentences of
clean documents are negative. A document's margin is its most toxic sentence's; a logistic
fit turns margins into scores.

By linearity a sentence's margin is a sum over its words of one number each, which a Python
worker computes once for a word and remembers. Training takes at most MAX_DOCS labelled
documents of each class, chosen by a hash of their id, from rows whose crc32(id) mod 5 isn't
0; scoring covers whole texts of all documents in one pass without a shuffle.

Defined cases: null, empty or wordless texts get the score of a margin without words; words
longer than WORD characters are taken in overlapping windows of that length; a label that is
null, or a doc_id that has labels of both kinds, teaches nothing; repeated rows are scored
alike; without any toxic or any clean label every score is the share of toxic labels (0 if
there are no labels); an empty table gives an empty one; other columns aren't looked at.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

DECAY, SPAN, POWER, FLOOR, WORD = 0.6, 7, 2, 0.2, 24
#: Documents of each class to learn from, landmarks, words a worker remembers.
MAX_DOCS, LANDMARKS, KNOWN_WORDS = 2500, 96, 300_000
#: Cost of a margin violation of a negative sentence.
COST = 10.0

_CODE = np.array([c - 96 if 97 <= c <= 122 else 27 + c % 4 if c >= 0x80 else 31 for c in range(256)], np.int32)
_SPACED = re.compile(rb"(?<!\S)(?:[a-z][\s.*_-]{1,2}){3,}[a-z](?!\S)")
_EDGES = bytes(c for c in range(128) if not chr(c).isalnum())
_MARKS = bytes(c for c in range(128) if not chr(c).isalpha())
_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased words; single letters that follow each other are one word."""
    raw = text.encode().lower()
    if _SPACED.search(raw):
        raw = _SPACED.sub(lambda m: re.sub(rb"[\s.*_-]", b"", m[0]), raw)
    return raw.split()


def pieces_of(token: bytes) -> list[bytes]:
    """A word without marks at its ends and, if it has some inside, also without those; in
    overlapping windows if it's long."""
    word = token.strip(_EDGES)
    if len(word) < 3:
        return []
    bare = word.translate(None, _MARKS)
    return [p for w in ((word,) if bare == word or len(bare) < 3 else (word, bare)) for p in ((w,) if len(w) <= WORD else (w[i : i + WORD] for i in range(0, len(w) - WORD // 2, WORD // 2)))]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: codes of their subsequences (a row a word), the weight of each."""
    n = len(words[0])
    if n not in _PLACES:
        at = np.array([p for p in combinations(range(n), 3) if p[2] - p[0] < SPAN])
        _PLACES[n] = at.T, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    (i, j, k), weight = _PLACES[n]
    code = _CODE[np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)]
    return (code[:, i] << 10) | (code[:, j] << 5) | code[:, k], weight


def self_kernel(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """K(s, s) of each row: the squared sum of weights of each distinct subsequence."""
    order = np.argsort(codes, axis=1)
    key = (np.take_along_axis(codes, order, 1) + (np.arange(len(codes), dtype=np.int64) << 15)[:, None]).ravel()
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.bincount(key[starts] >> 15, np.add.reduceat(weight[order].ravel(), starts) ** 2, len(codes))


class Kernel:
    """Kernel values of words with the landmarks."""

    def __init__(self, landmarks: list[bytes]) -> None:
        self.landmarks = landmarks
        self.table = np.zeros((1 << 15, len(landmarks)), np.float32)
        norm = np.empty(len(landmarks))
        for m, word in enumerate(landmarks):
            codes, weight = features([word])
            np.add.at(self.table[:, m], codes[0], weight)
            norm[m] = math.sqrt(self_kernel(codes, weight)[0])
        self.table /= norm.astype(np.float32)
        self.most = self.table.max(axis=1) if landmarks else np.zeros(1 << 15, np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """A row for each word (of three bytes or more). A word whose bound is under FLOOR is 0."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        least = FLOOR ** (1 / POWER)
        for rows in by_length.values():
            for at in range(0, len(rows), 512):
                some = np.array(rows[at : at + 512])
                codes, weight = features([words[i] for i in some])
                bound = self.most[codes] @ weight
                # K(s, s) is at least the sum of squared weights
                may = np.flatnonzero(bound >= least * math.sqrt(float(weight @ weight)))
                if not len(may):
                    continue
                own = np.sqrt(self_kernel(codes[may], weight))
                for a in range(0, len(may), 64):
                    part = may[a : a + 64]
                    k = (np.einsum("wcm,c->wm", self.table[codes[part]], weight) / own[a : a + 64, None]) ** POWER
                    out[some[part]] = np.where(k >= FLOOR, k, 0)
        return out


class Model:
    """Numbers for words, and from their sums by sentence a document's score."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("kernel", "known")}

    def learn(self, tokens: set[bytes]) -> dict[bytes, float]:
        """The numbers of all tokens; those not seen yet are computed together."""
        if not hasattr(self, "kernel"):
            self.kernel, self.known = Kernel(self.landmarks), {}
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = [t for t in tokens if t not in known]
        if new:
            parts = [(t, p) for t in new for p in pieces_of(t)]
            known.update(dict.fromkeys(new, 0.0))
            if parts and self.landmarks:
                distinct = list({p for _, p in parts})
                value = dict(zip(distinct, (self.kernel(distinct) @ self.weights).tolist(), strict=True))
                for t, p in parts:
                    if abs(value[p]) > abs(known[t]):
                        known[t] = value[p]
        return known

    def margin(self, tokens: list[bytes], known: dict[bytes, float]) -> float:
        best = now = 0.0
        for t in tokens:
            now += known[t]
            if t[-1:] in b".!?":
                best, now = max(best, now), 0.0
        return self.bias + max(best, now)

    def score(self, margin: float) -> float:
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, self.slope * margin + self.shift))))


def sentences(tokens: list[bytes]) -> list[list[bytes]]:
    out: list[list[bytes]] = [[]]
    for t in tokens:
        out[-1].append(t)
        if t[-1:] in b".!?":
            out.append([])
    return [s for s in out if s]


def choose_landmarks(toxic: list[list[bytes]], clean: list[list[bytes]], most: int) -> list[bytes]:
    """The words that speak most for toxic documents, by log odds of being in a document, each
    unlike those before it; where kernels are alike the earlier stands for both."""
    words = lambda docs: Counter(w for d in docs for w in {p for t in set(d) for p in pieces_of(t)})
    bad, good = words(toxic), words(clean)
    odds = {w: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((good[w] + 0.5) / (len(clean) + 1)) for w, n in bad.items() if n >= 3}
    ranked = sorted((w for w in odds if odds[w] > 2), key=lambda w: (-odds[w] * math.log1p(bad[w]), w))[: 12 * most]
    chosen: list[bytes] = []
    if ranked:
        close = Kernel(ranked)(ranked)
        taken: list[int] = []
        for i in range(len(ranked)):
            if not taken or close[i, taken].max() < 0.75**POWER:
                taken.append(i)
            if len(taken) == most:
                break
        chosen = [ranked[i] for i in taken]
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge SVM by Newton steps in the primal."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> Model:
    """A model from labelled texts."""
    same: dict[bytes, bytes] = {}
    docs, y = [[same.setdefault(w, w) for w in tokens_of(t)] for t in texts], np.array(labels)
    if not (0 < y.sum() < len(y)):
        share = float(y.mean()) if len(y) else 0.0
        return Model([], np.zeros(0), 0.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    marks = choose_landmarks([d for d, c in zip(docs, y, strict=True) if c], [d for d, c in zip(docs, y, strict=True) if not c], landmarks)
    if not marks:
        return Model([], np.zeros(0), 0.0, 0.0, math.log(y.mean() / (1 - y.mean())))
    kernel = Kernel(marks)
    values, eigen = np.linalg.eigh(kernel(marks).astype(float))
    root = eigen @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ eigen.T
    distinct = list({p for t in same for p in pieces_of(t)})
    value = {}
    for at in range(0, len(distinct), 20_000):
        part = distinct[at : at + 20_000]
        k = kernel(part)
        value.update((part[i], k[i]) for i in np.flatnonzero(k.any(axis=1)))
    # words that have nothing in common with any landmark, most of all, are left out
    of_token = {t: max(near, key=lambda v: float(v.sum())) for t in same if (near := [value[p] for p in pieces_of(t) if p in value])}
    rows, owner, empty = [], [], np.zeros(len(marks), np.float32)
    for i, d in enumerate(docs):
        for s in sentences(d):
            if near := [of_token[t] for t in s if t in of_token]:
                rows.append(np.sum(near, axis=0))
                owner.append(i)
        rows.append(empty)  # a sentence without such words
        owner.append(i)
    phi, owner = np.array(rows) @ root, np.array(owner)
    positive = y[owner] == 1
    value = np.array(rows).sum(axis=1)
    for _ in range(4):
        best = np.full(len(y), -1)
        order = np.argsort(value, kind="stable")
        best[owner[order]] = order
        speak = [i for i in best[y == 1] if np.any(rows[i])]
        use = np.r_[speak, np.flatnonzero(~positive)].astype(int)
        target = np.r_[np.ones(len(speak)), -np.ones(int((~positive).sum()))]
        cost = np.where(target > 0, COST * (target < 0).sum() / max(1, len(speak)), COST)  # both classes weigh the same
        w = train_svm(phi[use], target, cost)
        value = phi @ w[:-1] + w[-1]
    margins = np.full(len(y), -np.inf)
    np.maximum.at(margins, owner, value)
    slope, shift = logistic(margins, y)
    return Model(marks, root @ w[:-1], float(w[-1]), slope, shift)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge logistic fit by Newton steps."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """Learn from at most max_docs labelled rows of either class. That sample, bounded whatever the
    input, meets in one task, and the model alone (some kB) comes to the driver."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("_other")).where("y = _other").select(id_col, "y")
    sample = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
        sample = part if sample is None else sample.union(part)
    rows = text_or_empty(docs, id_col, text_col).join(F.broadcast(sample), id_col).dropDuplicates([id_col])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(r for b in batches for r in zip(*(b[c].to_pylist() for c in (id_col, text_col, "y")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in got], [int(r[2]) for r in got]))], pa.binary())], ["model"])

    return pickle.loads(rows.select(id_col, text_col, F.col("y").cast("int").alias("y")).repartition(1).mapInArrow(learn, "model binary").first()[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: id, held_out, score, predicted, and the columns in keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[c for c in keep if c != id_col])
    kept = [f for f in rows.schema.fields if f.name != "_text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in slices(batches):
            docs = [tokens_of(t) for t in b["_text"].to_pylist()]
            known = own.learn({t for d in docs for t in d})
            scores = [own.score(own.margin(d, known)) for d in docs]
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*(f.name for f in kept), "score", "predicted"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return score(docs, train(docs, labels, id_col, text_col), id_col, text_col, keep)
