"""Sessions as a keyed state machine over a log: phase, one outstanding card, retirement.

The log has commands of a session (request a card, answer the outstanding one, finish, end) and
changes of an opinion's approval (hide, restore), which concern every session that has its card. State
is keyed by buckets of sessions; a change goes to each bucket once, so it meets the cards that are out
there in the order of the log, and nothing has to be looked up elsewhere.

Rules: a card is issued if the session is active, has none outstanding, never answered that opinion and
the opinion is approved; an answer goes to the outstanding card of an active session; finish and end
change the phase, but nothing leads out of ended, and it is entered once; hiding an opinion retires each
outstanding card of it, once. Commands that don't fit change nothing and emit nothing, nor do commands
without a session, or requests and changes without an opinion.

A call to the state store, or a row handed to the machine, costs far more than a step of it. So rows come
packed, many of a bucket in one; a bucket's sessions are stored in pages, a page is read once a batch and
written once, and what is between is done in memory: the batch's rows as numbers, and the sessions of
the pages it meets.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMANDS, CHANGES = ("request", "answer", "finish", "end"), ("hide", "restore")
KINDS = (*COMMANDS, *CHANGES)
EMITTED = "session_id string, opinion_id string, kind string, seq long"
_COLUMNS = ["session_id", "opinion_id", "kind", "seq"]
#: Pages of a bucket's sessions, and rows of a frame that is given out.
PAGES, FRAME = 1024, 50_000


class _Codes:
    """Strings of a batch by number; null is -1."""

    def __init__(self) -> None:
        self.names, self.known = [], {}

    def __call__(self, column: pa.ChunkedArray) -> np.ndarray:
        found = column.combine_chunks().dictionary_encode()
        for name in (names := found.dictionary.to_pylist()):
            if name not in self.known:
                self.known[name] = len(self.names)
                self.names.append(name)
        return np.array([*(self.known[n] for n in names), -1], np.int32)[found.indices.fill_null(len(names)).to_numpy()]


class _Sessions(StatefulProcessor):
    """One bucket. Maps: pages of sessions, each with its phase, card and answered opinions; hidden
    opinions; and the pages where an opinion's card may be out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "sessions string")
        self.hidden = handle.getMapState("hidden", "opinion_id string", "yes boolean")
        self.holding = handle.getMapState("holding", "opinion_id string", "pages string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        who, what, chunks = _Codes(), _Codes(), []
        for data in (data for p in rows for data in p["rows"]):
            t = pa.ipc.open_stream(data).read_all()
            chunks.append((t["seq"].to_numpy(), who(t["session_id"]), t["code"].to_numpy(), what(t["opinion_id"])))
        seqs, whos, codes, whats = (np.concatenate(c) for c in zip(*chunks, strict=True))
        order = np.argsort(seqs, kind="stable")
        batch, out = _Batch(self), []
        for at in range(0, len(order), FRAME):
            some = order[at : at + FRAME]
            for seq, session, code, opinion in zip(seqs[some].tolist(), whos[some].tolist(), codes[some].tolist(), whats[some].tolist(), strict=True):
                batch.step(seq, who.names[session], KINDS[code], what.names[opinion] if opinion >= 0 else None, out)
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        batch.store()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


class _Batch:
    """What a batch has met of a bucket's state, in memory."""

    def __init__(self, state: _Sessions) -> None:
        self.state = state
        #: session: [phase, card or None, answered, page]; the page's sessions are in it once it is read
        self.sessions: dict[str, list] = {}
        self.loaded: dict[int, list[str]] = {}
        self.changed: set[int] = set()
        #: opinion: who has its card, in the pages read
        self.holders: dict[str, set[str]] = {}
        #: opinion: [hidden, as stored, pages where its card may be out, as stored]
        self.opinions: dict[str, list] = {}

    def load(self, page: int) -> None:
        found = self.state.pages.getValue((page,)) if self.state.pages.containsKey((page,)) else None
        self.loaded[page] = []
        for s, (phase, card, answered) in (json.loads(found[0]) if found else {}).items():
            self.loaded[page].append(s)
            self.sessions[s] = [phase, card, set(answered), page]
            if card is not None:
                self.holders.setdefault(card, set()).add(s)

    def opinion(self, name: str) -> list:
        if name not in self.opinions:
            hidden = self.state.hidden.containsKey((name,))
            pages = set(json.loads(self.state.holding.getValue((name,))[0])) if self.state.holding.containsKey((name,)) else set()
            self.opinions[name] = [hidden, hidden, pages, frozenset(pages)]
        return self.opinions[name]

    def session(self, name: str) -> list:
        if name not in self.sessions:
            page = zlib.crc32(name.encode()) % PAGES
            if page not in self.loaded:
                self.load(page)
            if name not in self.sessions:
                self.sessions[name] = ["active", None, set(), page]
                self.loaded[page].append(name)
        return self.sessions[name]

    def step(self, seq: int, session: str, kind: str, opinion: str | None, out: list[tuple]) -> None:
        if kind == "hide":
            known = self.opinion(opinion)
            for page in known[2]:
                if page not in self.loaded:
                    self.load(page)
            for s in self.holders.pop(opinion, ()):
                self.sessions[s][1] = None
                out.append((s, opinion, "retired", seq))
            self.changed |= known[2]
            known[0], known[2] = True, set()
        elif kind == "restore":
            self.opinion(opinion)[0] = False
        else:
            at = self.session(session)
            phase, card, answered, page = at
            if kind == "request":
                if phase == "active" and card is None and opinion not in answered and not (known := self.opinion(opinion))[0]:
                    at[1] = opinion
                    self.holders.setdefault(opinion, set()).add(session)
                    known[2].add(page)
                    self.changed.add(page)
                    out.append((session, opinion, "issued", seq))
            elif kind == "answer":
                if phase == "active" and card is not None:
                    answered.add(card)
                    at[1] = None
                    self.holders[card].discard(session)
                    self.changed.add(page)
                    out.append((session, card, "answered", seq))
            elif kind == "finish" and phase == "active" or kind == "end" and phase != "ended":
                at[0] = "reflect" if kind == "finish" else "ended"
                self.changed.add(page)
                out.append((session, None, at[0], seq))

    def store(self) -> None:
        for page in self.changed:
            # a session as every session begins needs no entry
            kept = {s: [phase, card, sorted(answered)] for s in self.loaded[page] for phase, card, answered, _ in [self.sessions[s]] if phase != "active" or card is not None or answered}
            if kept:
                self.state.pages.updateValue((page,), (json.dumps(kept, ensure_ascii=False, separators=(",", ":")),))
            elif self.state.pages.containsKey((page,)):
                self.state.pages.removeKey((page,))
        for name, (hidden, was_hidden, pages, were) in self.opinions.items():
            if hidden != was_hidden:
                self.state.hidden.updateValue((name,), (True,)) if hidden else self.state.hidden.removeKey((name,))
            if pages != were:
                self.state.holding.updateValue((name,), (json.dumps(sorted(pages)),)) if pages else self.state.holding.removeKey((name,))


def _packed(log: DataFrame, buckets: int) -> DataFrame:
    """log(seq, session_id, code, opinion_id, bucket), -1 for all buckets -> (bucket, rows): what a batch of rows
    has for each bucket, as one value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = batch["bucket"].to_numpy(), batch.drop_columns(["bucket"])
            to = range(buckets) if (own < 0).any() else np.unique(own)
            data = []
            for b in to:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows.take(pa.array(np.flatnonzero((own < 0) | (own == b)))))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(data, pa.binary())], ["bucket", "rows"])

    return log.mapInArrow(pack, "bucket int, rows binary")


def machine(log: DataFrame, buckets: int = 64) -> DataFrame:
    """log(seq, session_id, type, opinion_id), a stream in the order of seq from batch to batch ->
    (session_id, opinion_id, kind, seq): issued, answered, retired, reflect, ended. Needs the RocksDB
    state store (rocksdb())."""
    change, named = F.col("type").isin(*CHANGES), F.col("type").isin("request", *CHANGES)
    at = log.where(F.col("type").isin(*KINDS) & (change | F.col("session_id").isNotNull()) & (~named | F.col("opinion_id").isNotNull()))
    # no more of a row than the machine reads: changes go to all buckets
    code = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("type")) - 1).cast("byte")
    bucket = F.when(change, -1).otherwise(F.pmod(F.xxhash64("session_id"), F.lit(buckets))).cast("int")
    at = at.select(F.col("seq").cast("long"), F.when(~change, F.col("session_id")).alias("session_id"), code.alias("code"), F.when(named, F.col("opinion_id")).alias("opinion_id"), bucket.alias("bucket"))
    return _packed(at, buckets).groupBy("bucket").transformWithStateInPandas(_Sessions(), EMITTED, "Update", "None")


def rocksdb(spark) -> None:  # noqa: ANN001
    """The state store that processors with maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
