import dataclasses
from datetime import UTC, datetime

from ballotry.plans import snapshot
from ballotry.plans.analysis import Options, Result


def test_configuration_identity():
    good = snapshot.configuration(Options())
    assert snapshot.same_configuration(good, Options())
    assert not snapshot.same_configuration(good, Options(starts=5))
    assert not snapshot.same_configuration({**good, "parameters": {**good["parameters"], "starts": "4"}}, Options())
    assert not snapshot.same_configuration({**good, "parameters": {**good["parameters"], "more": 1}}, Options())
    assert not snapshot.same_configuration(None, Options())
    assert list(dataclasses.asdict(Options())) == list(good["parameters"])


def test_daily_runs(spark, tmp_path):
    store, calls = snapshot.Store(spark, str(tmp_path)), []

    def compute():
        calls.append(1)
        return Result("collecting", 3, 80)

    day = lambda n: datetime(2026, 1, n, 18, tzinfo=UTC)
    assert store.read(Options(), 0) == {"status": "waiting"}
    assert snapshot.run_daily(store, day(1), 1, 0, Options(), compute) == {"status": "updated", "day": "2026-01-02"}
    assert snapshot.run_daily(store, day(1), 2, 0, Options(), compute)["status"] == "already-completed"
    assert snapshot.run_daily(store, day(2), 1, 0, Options(), compute)["status"] == "unchanged"
    at = store.read(Options(), 0)
    assert at["status"] == "collecting" and store.read(Options(), 0, at["snapshot"])["status"] == "unchanged"
    assert store.read(Options(), 1) == {"status": "waiting"}
    assert snapshot.run_daily(store, day(3), 2, 0, Options(), compute)["status"] == "updated" and len(calls) == 2


def test_two_runs_at_once(spark, tmp_path):
    store, now = snapshot.Store(spark, str(tmp_path)), datetime(2026, 1, 1, 18, tzinfo=UTC)
    inner = []

    def compute():
        inner.append(snapshot.run_daily(snapshot.Store(spark, str(tmp_path)), now, 1, 0, Options(), compute)["status"])
        return Result("collecting", 3, 80)

    assert snapshot.run_daily(store, now, 1, 0, Options(), compute)["status"] == "updated" and inner == ["busy"]


def test_a_run_that_lost_its_lease_is_superseded(spark, tmp_path):
    store, now = snapshot.Store(spark, str(tmp_path)), datetime(2026, 1, 1, 18, tzinfo=UTC)
    later = now.replace(minute=20)

    def slow():
        assert snapshot.run_daily(snapshot.Store(spark, str(tmp_path)), later, 1, 0, Options(), lambda: Result("collecting", 4, 80))["status"] == "updated"
        return Result("collecting", 3, 80)

    assert snapshot.run_daily(store, now, 1, 0, Options(), slow)["status"] == "superseded"
    assert store.read(Options(), 0)["eligible"] == 4


def test_moderation_that_moves_meanwhile_supersedes(spark, tmp_path):
    store, now = snapshot.Store(spark, str(tmp_path)), datetime(2026, 1, 1, 18, tzinfo=UTC)
    assert snapshot.run_daily(store, now, 1, 0, Options(), lambda: Result("collecting", 3, 80), lambda: 1)["status"] == "superseded"
    assert store.read(Options(), 0) == {"status": "waiting"}
    assert snapshot.run_daily(store, now, 1, 1, Options(), lambda: Result("collecting", 3, 80), lambda: 1)["status"] == "updated"


def test_a_run_that_fails_gives_its_lease_back(spark, tmp_path):
    store, now = snapshot.Store(spark, str(tmp_path)), datetime(2026, 1, 1, 18, tzinfo=UTC)

    def fails():
        raise RuntimeError("no")

    for _ in range(2):
        try:
            snapshot.run_daily(store, now, 1, 0, Options(), fails)
        except RuntimeError:
            continue
        raise AssertionError
    assert snapshot.run_daily(store, now, 1, 0, Options(), lambda: Result("collecting", 3, 80))["status"] == "updated"
