import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ballotry.streaming import sessions
from ballotry.streaming.counters import Counters
from ballotry.streaming.events import append_stream, pieces, read_stream

LOG = "seq long, session_id string, type string, opinion_id string"


def by_hand(log):
    """The machine's rules, one row at a time over the whole log."""
    phase, card, answered, hidden, out = {}, {}, set(), set(), []
    for seq, s, kind, o in sorted(log):
        if kind == "hide":
            hidden.add(o)
            for who in [w for w, c in card.items() if c == o]:
                del card[who]
                out.append((who, o, "retired", seq))
        elif kind == "restore":
            hidden.discard(o)
        elif kind == "request" and phase.get(s, "active") == "active" and s not in card and o not in hidden and (s, o) not in answered:
            card[s] = o
            out.append((s, o, "issued", seq))
        elif kind == "answer" and phase.get(s, "active") == "active" and s in card:
            answered.add((s, card[s]))
            out.append((s, card.pop(s), "answered", seq))
        elif (kind == "finish" and phase.get(s, "active") == "active") or (kind == "end" and phase.get(s) != "ended"):
            phase[s] = "reflect" if kind == "finish" else "ended"
            out.append((s, None, phase[s], seq))
    return sorted(out, key=str)


def test_sessions_over_a_restart(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["request"] * 6 + ["answer"] * 4 + ["hide", "restore", "hide", "finish", "end"]
    log = [(i, f"s{rng.randrange(12)}", k, f"o{rng.randrange(5)}") for i in range(600) for k in [rng.choice(kinds)] if k not in ("finish", "end") or rng.random() < 0.15]
    sessions.rocksdb(spark)
    for i in range(0, 600, 150):  # a run for each part, each from the checkpoint of the one before
        spark.createDataFrame([r for r in log if i <= r[0] < i + 150], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        out = sessions.machine(read_stream(spark, str(tmp_path / "log"), "*.parquet", 1), buckets=3)
        append_stream(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("session_id", "opinion_id", "kind", "seq").collect()), key=str)
    assert found == by_hand(log) and {r[2] for r in found} == {"issued", "answered", "retired", "reflect", "ended"}


class Maps:
    """State in dictionaries, whose calls are counted."""

    def __init__(self):
        self.maps, self.calls = {}, 0

    def getMapState(self, name, key, value):  # noqa: N802
        state, at = self, self.maps.setdefault(name, {})

        class Map:
            def __getattr__(self, call):
                state.calls += 1
                return {"containsKey": at.__contains__, "getValue": at.__getitem__, "updateValue": at.__setitem__, "removeKey": at.__delitem__}[call]

        return Map()


def test_state_is_called_by_pages_not_by_rows(monkeypatch):
    monkeypatch.setattr(sessions, "PAGES", 8)
    monkeypatch.setattr(sessions, "FRAME", 500)
    rng, state, out = random.Random(3), Maps(), []
    kinds = ["request"] * 30 + ["answer"] * 12 + ["hide", "restore", "finish", "end"]
    log = [(i, f"s{rng.randrange(900)}", rng.choice(kinds), f"o{rng.randrange(15)}") for i in range(20000)]
    for i in range(0, 20000, 5000):
        part = log[i : i + 5000]
        rng.shuffle(part)
        data = []
        for at in range(0, 5000, 1000):
            rows = pa.table({"seq": pa.array([r[0] for r in part[at : at + 1000]]), "session_id": [None if r[2] in sessions.CHANGES else r[1] for r in part[at : at + 1000]], "code": pa.array([sessions.KINDS.index(r[2]) for r in part[at : at + 1000]], pa.int8()), "opinion_id": [r[3] if r[2] in ("request", *sessions.CHANGES) else None for r in part[at : at + 1000]]})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_table(rows)
            data.append(sink.getvalue().to_pybytes())
        one = sessions._Sessions()
        one.init(state)
        out += [r for p in one.handleInputRows((0,), iter([pd.DataFrame({"rows": data[:2]}), pd.DataFrame({"rows": data[2:]})]), None) for r in p.itertuples(index=False, name=None)]
    assert sorted(out, key=str) == by_hand(log) and {r[2] for r in out} == {"issued", "answered", "retired", "reflect", "ended"}
    assert state.calls <= 4 * (3 * 8 + 6 * 15)  # a batch: pages looked for, read and written; opinions so too, in two maps


def test_pieces_of_a_log_are_in_order(spark):
    log = spark.range(1000).select((F.col("id") * 7 % 1000).alias("seq"))
    found = [sorted(r["seq"] for r in p.collect()) for p in pieces(log, "seq", 300)]
    assert len(found) == 4 and sum(found, []) == list(range(1000)) and max(map(len, found)) <= 310
    assert [p.count() for p in pieces(log, "seq", 1000)] == [1000] and [p.count() for p in pieces(log.where("seq < 0"), "seq", 10)] == [0]


CHANGE = "seq long, session_id string, opinion_id string, value int, sign int, approved boolean"


def test_counters_merge_each_batch_once(spark, tmp_path):
    rng = random.Random(4)
    rows, stored = [], {}
    for i in range(300):
        s, o = f"s{rng.randrange(9)}", f"o{rng.randrange(6)}"
        if rng.random() < 0.15:
            rows.append((i, None, o, None, None, rng.random() < 0.6))
        elif (s, o) in stored:
            rows.append((i, s, o, stored.pop((s, o)), -1, None))
        else:
            stored[s, o] = rng.choice([-1, 0, 1, 2])
            rows.append((i, s, o, stored[s, o], 1, None))
    at = Counters(spark, str(tmp_path / "counters"))
    for i in range(0, 300, 100):
        spark.createDataFrame(rows[i : i + 100], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        at.run(read_stream(spark, str(tmp_path / "log"), "*.parquet", 1), str(tmp_path / "state")).awaitTermination()
    approved = {}
    for r in rows:
        approved |= {r[2]: r[5]} if r[5] is not None else {}
    mine = {s: sum(bool(approved.get(o)) for w, o in stored if w == s) for s, _ in stored}
    assert {r["session_id"]: r["n"] for r in at.table("sessions").collect()} == {s: n for s, n in mine.items() if n}
    assert tuple(at.totals().first()) == (sum(mine.values()), sum(n > 0 for n in mine.values()))
    counts = {r["opinion_id"]: (r["agree"], r["disagree"], r["pass"], r["unrelated"]) for r in at.table("opinions").collect()}
    assert {o: c for o, c in counts.items() if any(c)} == {o: tuple(sum(v == k and p == o for (_, p), v in stored.items()) for k in (-1, 1, 0, 2)) for o in {p for _, p in stored}}
    before = at.states.current()
    assert not at.merge(spark.createDataFrame(rows[:10], CHANGE), before["batch"])  # the same batch again
    assert at.states.current() == before


def test_a_batch_whose_pointer_is_lost_counts_once(spark, tmp_path, monkeypatch):
    at, batch = Counters(spark, str(tmp_path)), spark.createDataFrame([(0, None, "o", None, None, True), (1, "s", "o", 1, 1, None)], CHANGE)
    with monkeypatch.context() as m:
        m.setattr(at.states, "swap", lambda *_: None)
        with pytest.raises(RuntimeError):
            at.merge(batch, 0)
    assert at.merge(batch, 0) and tuple(at.totals().first()) == (1, 1)
    assert at.table("answers").agg(F.sum("n")).first()[0] == 1
