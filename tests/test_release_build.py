import json

import pytest
from pyspark.sql import functions as F

from ballotry.plans import release_build as rb
from ballotry.plans.state import States
from ballotry.sources import files

SIZES = rb.Sizes(page_rows=20, page_bytes=700, block_pages=2, index_refs=3, batch_blocks=2, batch_indexes=2)


def sources(spark, n=230, hidden=()):
    """Five opinions, two of them not approved, and rows on all of them."""
    ops = spark.createDataFrame([(i, f"o{i}", 1, "pending" if i == 3 else "hidden" if i in hidden else "approved") for i in range(1, 6)], "seq long, id string, revision long, status string")
    ops = ops.withColumn("line", F.to_json(F.struct("id")))
    rows = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.concat(F.lit("o"), F.col("id") % 5 + 1).alias("opinion_id"))
    line = F.to_json(F.struct("seq", "opinion_id", F.repeat(F.lit("é"), (F.col("seq") % 40).cast("int")).alias("t")))
    seen = lambda marks: rows.where(F.col("seq") <= marks["events"]).withColumn("line", F.to_json(F.struct("seq", "opinion_id")))
    return rb.Sources(ops, rows.withColumn("line", line), seen, lambda: {"opinions": 5, "responses": 211, "events": 90})


def test_a_release_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    whole = rb.Release(spark, str(tmp_path / "a"), sources(spark), SIZES)
    whole.prepare("r1", 7, "2026-01-01T00:00:00Z")
    done = whole.build(7)
    assert (done["status"], done["counts"]["opinions"]["rows"], done["counts"]["presentations"]["rows"]) == ("draft", 4, 72)
    n = 0
    again = rb.Release(spark, str(tmp_path / "b"), sources(spark), SIZES)
    again.prepare("r1", 7, "2026-01-01T00:00:00Z")
    write = rb.Release._write

    def dies(self, rows, name):  # every third write is the last of a process: its files stay, nothing names them
        nonlocal n
        path, n = write(self, rows, name), n + 1
        if n % 3 == 0:
            raise KeyboardInterrupt
        return path

    monkeypatch.setattr(rb.Release, "_write", dies)
    stops = 0
    while again.states.current()["status"] == "preparing":
        again = rb.Release(spark, str(tmp_path / "b"), sources(spark, n=400), SIZES)  # later rows don't get in
        try:
            again.advance(7)
        except KeyboardInterrupt:
            stops += 1
    assert stops > 3 and again.states.current()["sha256"] == done["sha256"]
    bodies = [r["body"] for r in again.parts("responses").orderBy("part").collect()]
    lines = [json.loads(x) for b in bodies for x in b.splitlines()]
    assert [x["seq"] for x in lines] == [s for s in range(1, 212) if s % 5 + 1 != 3] and all(len(b.encode()) <= 700 for b in bodies)


def test_indexes_lead_from_the_root_to_every_page(spark, tmp_path):
    r = rb.Release(spark, str(tmp_path), sources(spark), SIZES)
    r.prepare("r1", 7, "2026-01-01T00:00:00Z", "why", {"tags": ["t"]})
    r.build(7)
    root = json.loads(r.read())
    assert root["tags"] == ["t"] and root["release"]["description"] == "why"
    for kind in rb.KINDS:
        at, seen = root["tables"][kind]["index"], []
        while at:
            page = json.loads(r.read(at["part"]))
            assert len(page["pages"]) == at["row_count"] <= 3
            seen += page["pages"]
            at = page["next"]
        assert [p["part"] for p in seen] == [f"d-{kind}-{i:012}" for i in range(1, root["tables"][kind]["pages"] + 1)]
        assert sum(p["row_count"] for p in seen) == root["tables"][kind]["rows"]
        assert all(len(r.read(p["part"]).encode()) == p["byte_length"] for p in seen)
    with pytest.raises(ValueError):
        r.read("../state")
    with pytest.raises(KeyError):
        r.read("d-opinions-000000000099")


def test_conflicts_and_publication(spark, tmp_path):
    r = rb.Release(spark, str(tmp_path / "a"), sources(spark), SIZES)
    first = r.prepare("r1", 7, "2026-01-01T00:00:00Z")
    assert r.prepare("other", 9, "2027-01-01T00:00:00Z") == first
    with pytest.raises(rb.Conflict):
        r.read()
    with pytest.raises(rb.Conflict):
        r.advance(7, expected=5)
    with pytest.raises(rb.Conflict):
        r.publish(sources(spark).opinions, 7, "2026-01-02")
    r.build(7)
    with pytest.raises(rb.Conflict):
        r.publish(sources(spark, hidden=(2,)).opinions, 7, "2026-01-02")
    assert r.publish(sources(spark).opinions, 7, "2026-01-02")["status"] == "released"
    assert r.advance(8)["status"] == "released"
    gone = rb.Release(spark, str(tmp_path / "b"), sources(spark), SIZES)
    gone.prepare("r2", 7, "2026-01-01T00:00:00Z")
    gone.advance(7)
    for _ in range(2):
        with pytest.raises(rb.Conflict):
            gone.advance(8)
    assert gone.states.current()["status"] == "invalidated"


def test_of_two_writers_one_is_first(spark, tmp_path):
    one, two = States(spark, str(tmp_path)), States(spark, str(tmp_path))
    assert one.current() is None and one.swap(0, {"a": 1}) == {"a": 1, "number": 1}
    assert two.swap(0, {"a": 2}) is None and two.current() == {"a": 1, "number": 1}
    held = one.acquire(1000, 500)
    assert two.acquire(1499, 500) is None
    taken = two.acquire(1500, 500)  # the first one's time is over
    assert one.finish(held, {"a": 3}) is None and two.finish(taken, {"a": 4})["a"] == 4
    assert "lease" not in one.current() and [s["number"] for s in one.history()] == [1, 2, 3, 4]


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        for number in range(5):
            won = list(pool.map(lambda i, n=number: States(spark, f"file://{tmp_path}").swap(n, {"by": i}), range(8)))
            assert sum(w is not None for w in won) >= 1
            assert States(spark, f"file://{tmp_path}").current()["by"] in [w["by"] for w in won if w]


def test_small_steps_are_made_by_few_jobs(spark, tmp_path, monkeypatch):
    big = rb.Release(spark, str(tmp_path / "a"), sources(spark), SIZES)
    big.prepare("r1", 7, "2026-01-01T00:00:00Z")
    done, n, seen = big.build(7), 0, set()
    write = rb.Release._write

    def counted(self, rows, name):
        nonlocal n
        n += 1
        return write(self, rows, name)

    monkeypatch.setattr(rb.Release, "_write", counted)
    monkeypatch.setattr(rb, "RUN_STEPS", 10)
    one = rb.Sizes(**{**vars(SIZES), "block_pages": 1, "batch_blocks": 1, "batch_indexes": 1})
    small = rb.Release(spark, str(tmp_path / "b"), sources(spark), one)
    small.prepare("r1", 7, "2026-01-01T00:00:00Z")
    while (now := small.advance(7))["status"] == "preparing":
        if now["phase"] == "responses:pages":
            seen.add(now["counts"]["responses"]["pages"])
            assert small.parts("responses").count() == now["counts"]["responses"]["pages"]  # what is ahead isn't there yet
        if now["number"] % 4 == 0:  # stopped in a run: another process commits what is ahead
            small = rb.Release(spark, str(tmp_path / "b"), sources(spark), one)
    assert now["sha256"] == done["sha256"] and len(seen) > 8
    # members, three kinds frozen (2 each), pages and indexes (1 each, 2 of responses' pages), the manifest
    assert now["number"] > 25 and n <= 16
    assert small.every_part().select("part").distinct().count() == small.every_part().count() == big.every_part().count()


def test_a_state_is_read_once(spark, tmp_path, monkeypatch):
    for number in range(20):
        States(spark, str(tmp_path)).swap(number, {"n": number})
    read, found = files.read, []
    monkeypatch.setattr(files, "read", lambda s, path: found.append(path) or read(s, path))
    at = States(spark, str(tmp_path))
    assert at.current() == {"n": 19, "number": 20} and len(at.history()) == len(at.history()) == 20
    assert at.swap(20, {"n": 20}) and at.current()["n"] == 20 and len(found) <= 26
    assert States(spark, str(tmp_path)).swap(21, {"n": 21}) and at.current()["n"] == 21
