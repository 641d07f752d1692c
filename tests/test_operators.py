import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotry.operators import ballots, bridges, components, evaluate, geometry, matrix, moderation, release, routing
from ballotry.plans import analysis
from ballotry.sources import synthetic
from ballotry.streaming import events


def blocks(n=100, m=12):
    """Two opposite blocks; all agree with p0."""
    return [(f"s{i:04d}", f"p{j:02d}", -1 if j == 0 else (1 if (i < n // 2) == (j % 2 == 0) else -1)) for i in range(n) for j in range(m)]


def votes(spark, rows):
    return spark.createDataFrame(rows, "session_id string, opinion_id string, value int")


def test_two_blocks(spark):
    r = analysis.analyze(votes(spark, blocks()))
    assert (r.status, [n for _, n in r.groups]) == ("ready", [50, 50])
    assert bridges.ranked(r.bridges).first()["opinion_id"] == "p00"
    assert r.silhouette == pytest.approx(1)


def test_more_opinions_than_are_gathered(spark, monkeypatch):
    rows = [(s, p, v if hash_ % 7 else -v) for hash_, (s, p, v) in enumerate(blocks())]
    options = analysis.Options(pca_iterations=6)
    gathered = analysis.analyze(votes(spark, rows), options=options)
    monkeypatch.setattr(matrix, "MAX_OPINIONS", 5)
    monkeypatch.setattr(matrix, "BLOCK_ANSWERS", 100)
    jobs = analysis.analyze(votes(spark, rows), options=options)
    assert jobs.status == gathered.status and jobs.groups == gathered.groups
    assert jobs.model.components[0] == pytest.approx(gathered.model.components[0], abs=1e-9)
    assert jobs.model.components[1] == pytest.approx(gathered.model.components[1], abs=1e-9)
    assert jobs.model.explained == pytest.approx(gathered.model.explained)


@pytest.mark.parametrize(
    ("rows", "status"),
    [
        ([(s, p, -1) for s, p, _ in blocks()], "uniform"),
        ([(s, p, 0) for s, p, _ in blocks()], "collecting"),
        (blocks(78), "collecting"),
        ([(s, p if i < 600 else "q" + p, v) for i, (s, p, v) in enumerate(blocks())], "collecting"),
        ([], "collecting"),
    ],
)
def test_gates(spark, rows, status):
    assert analysis.analyze(votes(spark, rows)).status == status


def test_projection_repeats_batch_points(spark):
    data = votes(spark, blocks())
    r = analysis.analyze(data)
    again = matrix.project(data, r.model).join(r.points.select("session_id", F.col("x").alias("bx"), F.col("group").alias("bg")), "session_id")
    assert again.where(F.abs(F.col("x") - F.col("bx")) > 1e-10).count() == 0
    assert again.where("group != bg").count() == 0


@pytest.mark.parametrize("change", [{"max_groups": 1}, {"min_sessions": 0}, {"bridge_z": 11}, {"min_silhouette": math.nan}, {"starts": 1.5}])
def test_options(change):
    with pytest.raises(ValueError):
        analysis.Options(**change)


def test_duplicate_rules(spark):
    rows = spark.createDataFrame([("s", "p", 1, 1), ("s", "p", -1, 2), ("s", "p", 2, 3)], "session_id string, opinion_id string, value int, arrival int")
    assert ballots.last_valid(rows).first()["value"] == -1
    assert ballots.first_stored(rows).first()["value"] == 1


def test_routing_sums_to_one_and_prefers_the_new(spark):
    rows = [("s", "a", "t", 50, 50, 0, 0), ("s", "b", "t", 100, 0, 0, 0), ("s", "c", "u", 0, 0, 0, 0), ("r", "a", "t", 0, 0, 0, 0)]
    at = routing.distribution(spark.createDataFrame(rows, "session_id string, id string, tag_id string, agree long, disagree long, pass long, unrelated long"), spark.createDataFrame([("s", "t", 3)], "session_id string, tag_id string, n long"))
    p = {(r["session_id"], r["id"]): r["probability"] for r in at.collect()}
    assert p["s", "a"] > p["s", "b"] and p["s", "c"] > p["s", "a"] + p["s", "b"]
    assert sum(v for (s, _), v in p.items() if s == "s") == pytest.approx(1, abs=1e-12) and p["r", "a"] == pytest.approx(1)
    assert {r["id"] for r in routing.draw(at, F.lit(0.9999999)).collect()} == {"a", "c"}


def test_hulls(spark):
    assert geometry.convex_hull([]) == [] and geometry.convex_hull([(9, 3), (9, 3)]) == [(9, 3)]
    assert geometry.convex_hull([(-10 + i, -2 + 0.2 * i) for i in range(21)])[0] == (-10, -2)
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (2, 2), (math.nan, 1)]
    assert geometry.convex_hull(square) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    rows = geometry.hulls(spark.createDataFrame([("g", float(x), float(y)) for x, y in square], "group string, x double, y double")).orderBy("ord").collect()
    assert [(r["x"], r["y"]) for r in rows] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert geometry.padded_hull(square, -1) == geometry.convex_hull(square) and len(geometry.padded_hull([(0, 0)], 1)) == 24


def test_ari(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    assert evaluate.ari(frame([(0, 1), (0, 1), (1, 0), (1, 0)]), "a", "b").first()["ari"] == 1
    assert evaluate.ari(frame([(0, 0), (0, 1), (1, 0), (1, 1)]), "a", "b").first()["ari"] == pytest.approx(-0.5)
    assert evaluate.ari(frame([(0, 0)]), "a", "b").first()["ari"] is None


def test_binomial_tail(spark):
    rows = {r["n"]: r for r in evaluate.binomial_tail(spark.createDataFrame([(n,) for n in (0, 3, 10, 5000)], "n int")).collect()}
    assert rows[0]["one"] == 1 and 0 < rows[5000]["one"] < 1e-40
    assert rows[3]["expected"] == pytest.approx(10) and rows[10]["one"] == pytest.approx(386 / 1024)


def test_pages(spark, tmp_path):
    rows = spark.range(1, 1252).select(F.col("id").alias("seq"), F.concat(F.lit("line "), "id").alias("line"), (F.col("id") % 2 == 1).alias("included"))
    at = release.pages(release.numbered(rows, ["seq"]))
    pages = at.orderBy("page").collect()
    assert [(p["page"], p["first_rn"], p["last_rn"], p["rows"]) for p in pages] == [(1, 1, 500, 250), (2, 501, 1000, 250), (3, 1001, 1251, 126)]
    release.write_pages(at, str(tmp_path / "pages"))
    assert release.verify(spark, str(tmp_path / "pages")).count() == 0
    assert release.read_part(spark, str(tmp_path / "pages"), pages[0]["sha256"]).count() == 250


@pytest.mark.parametrize(("page_rows", "page_bytes", "block_pages", "group"), [(7, 60, 2, 3), (5, 1000, 1, 2), (50, 45, 1, 4), (10, 120, 3, 1024)])
def test_pages_are_greedy(spark, page_rows, page_bytes, block_pages, group):
    rng = np.random.default_rng(page_bytes)
    data = [(i, "é" * int(rng.integers(0, 20)), bool(rng.random() < 0.7) and not 90 <= i < 150) for i in range(1, 400)]
    want, first, held, size, last = [], None, [], 0, 0
    for rn, line, good in data:  # the rule one row at a time
        n = len(line.encode()) + 1 if good else 0
        if first is not None and (rn - first == page_rows or size + n > page_bytes):
            want += [(first, last, len(held), size, "".join(held))] if held else []
            first, held, size = None, [], 0
        first, last, size = first or rn, rn, size + n
        held += [line + "\n"] if good else []
    want += [(first, last, len(held), size, "".join(held))] if held else []
    rows = spark.createDataFrame(data, "rn long, line string, included boolean")
    found = release.pages(rows, page_rows=page_rows, page_bytes=page_bytes, block_pages=block_pages, group=group).orderBy("page").collect()
    assert [(p["first_rn"], p["last_rn"], p["rows"], p["byte_length"], p["body"]) for p in found] == want
    assert [p["page"] for p in found] == list(range(1, len(want) + 1))


def test_no_page_holds_a_longer_line(spark):
    with pytest.raises(Exception, match="doesn't fit a page"):
        release.pages(spark.createDataFrame([(1, "x" * 100, True)], "rn long, line string, included boolean"), page_bytes=100).collect()
    assert release.pages(spark.createDataFrame([], "rn long, line string, included boolean")).collect() == []


def test_page_index(spark):
    rows = release.page_index(spark.range(257).select(F.col("id").alias("part"))).orderBy("index").collect()
    assert [(r["index"], len(r["parts"]), r["next"]) for r in rows] == [(0, 256, None), (1, 1, 0)]
    assert rows[1]["parts"] == [0]


def test_conflicting_actions(spark):
    at = spark.createDataFrame([("a", "pending", 0), ("b", "approved", 2)], "id string, status string, revision long")
    done = moderation.apply_actions(at, spark.createDataFrame([("a", "approve", 0), ("b", "hide", 1), ("c", "keep", 0)], "id string, action string, expected_revision long"))
    assert {r["id"]: (r["applied"], r["next_status"]) for r in done.collect()} == {"a": (True, "approved"), "b": (False, "approved"), "c": (False, None)}


def test_stream_of_removals_equals_recount(spark, tmp_path):
    log = spark.createDataFrame([("p", -1, 1), ("p", 1, 1), ("q", 0, 1), ("p", -1, -1), ("q", 2, 1)], "opinion_id string, value int, sign int")
    log.write.parquet(str(tmp_path / "log"))
    stream = events.read_stream(spark, str(tmp_path / "log"), "*.parquet")
    events.run_available(events.counters(stream), str(tmp_path / "state"), "recount").awaitTermination()
    assert sorted(map(tuple, spark.table("recount").collect())) == sorted(map(tuple, events.counters(log).collect()))


@pytest.mark.parametrize("name", ["two", "uniform", "disconnected", "late"])
def test_scenarios(spark, name):
    rows = synthetic.ballots(spark, name, 7, 200)
    per = rows.groupBy("session_id").count()
    assert per.count() == 200 and per.agg(F.max("count")).first()[0] == synthetic.SCENARIOS[name].answers
    assert rows.groupBy("session_id", "opinion_id").count().where("count > 1").count() == 0
    assert synthetic.true_bridges(spark, name, 7, 200).count() == {"two": 8, "uniform": 0, "disconnected": 8, "late": 8}[name]


def test_connected_keeps_the_callers_caches(spark):
    from ballotry.operators import matrix

    def ask(patterns):
        votes = spark.createDataFrame([(f"s{i:04}", o, 1) for i, p in enumerate(patterns) for o in p], "session_id string, opinion_id string, value int").cache()
        votes.count()
        sessions, kept = votes.select("session_id").distinct(), votes.select("opinion_id").distinct()
        got = matrix.connected(votes, sessions, kept)
        assert votes.storageLevel.useMemory and spark.sparkContext._jsc.sc().getPersistentRDDs().size() >= 1
        votes.unpersist()
        return got

    chain = [[f"o{k:03}" for k in range(i, i + 4)] for i in range(40)]  # each shares three with the next alone
    assert ask(chain)
    assert not ask([*chain[:4], *chain[5:]])
    assert not ask([*chain, ["o000", "o001", "x", "y"]])
    assert ask([["a", "b", "c"]]) and not ask([["a", "b", "c"], ["a", "b"]])
    rng = np.random.default_rng(3)
    many = [[f"o{k}" for k in rng.choice(14, 5, replace=False)] for _ in range(60)]
    up = {i: i for i in range(60)}
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(60):
        for j in range(i):
            if len({*many[i]} & {*many[j]}) >= 3:
                up[root(i)] = root(j)
    assert ask(many) == (len({root(i) for i in range(60)}) == 1)


@pytest.mark.parametrize(("shared", "opinions", "size"), [(3, 30, 6), (3, 14, 5), (2, 40, 4)])
def test_overlap_components(spark, shared, opinions, size):
    rng = np.random.default_rng(opinions)
    sets = {f"s{i:04}": {f"o{k}" for k in rng.choice(opinions, rng.integers(1, size + 1), replace=False)} for i in range(150)}
    least = {s: s for s in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= shared:
                    least[a] = min(least[a], least[b])
        if all(least[a] == least[b] for a in sets for b in sets if len(sets[a] & sets[b]) >= shared):
            break
    rows = spark.createDataFrame([(s, o, 1) for s, p in sets.items() for o in p], "session_id string, opinion_id string, value int")
    found = matrix.overlap_components(rows, rows.select("session_id").distinct(), rows.select("opinion_id").distinct(), shared)
    assert {r["session_id"]: r["component"] for r in found.collect()} == least
    assert len(set(least.values())) > 1


def test_a_long_chain_in_few_rounds(spark):
    """A chain of 10,000 links and a piece of its own: rounds by the logarithm of its length."""
    links = spark.range(10_000).select(F.format_string("n%05d", "id").alias("a"), F.format_string("n%05d", F.col("id") + 1).alias("b")).where("a <> 'n09000'")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    found, rounds = components.components(nodes, links, small=0)
    assert rounds <= 20
    assert sorted((r["component"], r["count"]) for r in found.groupBy("component").count().collect()) == [("n00000", 9001), ("n09001", 1000)]


def test_analysis_drops_invalid_answers_and_marks_mine(spark):
    from ballotry.plans.analysis import Options, analyze

    rows = [(f"s{i:03}", f"p{j:02}", -1 if j == 0 or (i < 10) == (j % 2 == 0) else 1) for i in range(20) for j in range(12)]
    bad = [("s000", "p99", 2), ("s001", "p98", 7), ("s002", "p97", None)]
    votes = spark.createDataFrame(rows + bad, "session_id string, opinion_id string, value int")
    out = analyze(votes, options=Options(min_sessions=8), mine="s003")
    assert out.status == "ready" and [n for _, n in out.groups] == [10, 10]
    assert out.diagnostics["retained_opinions"] == 12
    assert [r["session_id"] for r in out.points.where("mine").collect()] == ["s003"]


@pytest.mark.parametrize("seed", range(3))
def test_located_draws_are_those_of_the_distribution(spark, seed):
    rng = np.random.default_rng(seed)
    ops = [(f"o{i:02}", f"t{rng.integers(4)}", f"s{rng.integers(12):02}" if rng.random() < 0.4 else None, *(int(x) for x in rng.integers(0, 9, 4) * rng.integers(0, 2))) for i in range(25)]
    opinions = spark.createDataFrame(ops, "id string, tag_id string, author_session string, agree long, disagree long, pass long, unrelated long")
    seen = [(f"s{s:02}", f"o{o:02}") for s in range(12) for o in range(25) if rng.random() < (1 if s == 3 else 0.3)]  # one has seen all
    answers = spark.createDataFrame(seen, "session_id string, opinion_id string")
    issued = spark.createDataFrame([(f"s{s:02}", f"t{t}", int(rng.integers(1, 6))) for s in range(12) for t in range(4) if rng.random() < 0.5], "session_id string, tag_id string, n long")
    who = spark.createDataFrame([(f"s{s:02}", (0.0, 0.9999999999999999, 0.37, 0.5, 0.81)[s % 5] if s < 10 else float(rng.random())) for s in range(13)], "session_id string, r double")
    found, full = ({x["session_id"]: x["id"] for x in routing.draw_located(who, opinions, answers, issued, most).collect()} for most in (1000, 0))
    assert found == full and "s03" not in found and len(found) == 12
    assert routing.draw_located(who, opinions.limit(0), answers, issued).collect() == []


def test_next_numbers_go_on_without_gaps(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 7}", i) for i in range(50)], "k string, at long").repartition(5)
    last = spark.createDataFrame([("hot", 10), ("k3", 2), ("gone", 4)], "k string, number long")
    got = {}
    for r in ballots.next_numbers(rows, "k", ["at"], last).orderBy("k", "at").collect():
        got.setdefault(r["k"], []).append(r["sequence"])
    assert got["hot"] == list(range(11, 511)) and got["k3"][0] == 3 and got["k1"] == list(range(1, len(got["k1"]) + 1))


def test_of_two_appends_one_has_to_be_done_again(spark, tmp_path):
    from ballotry.plans.ledger import Ledger

    book = Ledger(spark, str(tmp_path), "s string, o string, at long", ["s", "o"], "s", ["at"])
    batch = lambda *rows: spark.createDataFrame(rows, "s string, o string, at long")
    assert book.append(batch(("a", "x", 1), ("a", "x", 2), ("b", "x", 3)), 0) == 2
    began = book.states.current()
    assert book.append(batch(("a", "y", 4)), 1) == 1
    with pytest.raises(RuntimeError):
        book.append(batch(("a", "z", 5)), 2, from_state=began)
    assert book.append(batch(("a", "z", 5), ("a", "y", 6)), 2) == 1
    assert book.append(batch(("a", "z", 5)), 2) is None
    assert sorted((r["s"], r["o"], r["sequence"]) for r in book.rows().collect()) == [("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "x", 1)]


@pytest.mark.parametrize("gathered", [8_000_000, 0])
def test_multiplication_over_blocks(spark, tmp_path, monkeypatch, gathered):
    """5,000 opinions: one shuffle deals the votes, none multiplies; sums are those of the dense matrix."""
    from ballotry.sources.files import Tables

    monkeypatch.setattr(matrix, "BLOCK_ANSWERS", 3000)
    monkeypatch.setattr(matrix, "GATHERED", gathered)
    rng = np.random.default_rng(8)
    x = {(f"s{s:03}", int(o)): int(rng.integers(-1, 2)) for s in range(400) for o in rng.choice(5000, 30, replace=False)}
    data = votes(spark, [(s, f"p{o:04}", v) for (s, o), v in x.items()]).repartition(3)
    kept = ballots.retained(data, 1)
    ids = [r["opinion_id"] for r in kept.orderBy("opinion_id").collect()]
    blocks = matrix.session_blocks(data, kept, ids, Tables(spark, "t"))
    means = {r["opinion_id"]: r["mean"] for r in kept.collect()}
    dense = np.zeros((400, len(ids)))
    at = {o: i for i, o in enumerate(ids)}
    for (s, o), v in x.items():
        dense[int(s[1:]), at[f"p{o:04}"]] = v - means[f"p{o:04}"]
    v = rng.normal(size=(len(ids), 2))
    assert matrix.multiplied(blocks, v) == pytest.approx(dense.T @ (dense @ v), abs=1e-9)
    assert matrix.multiplied(blocks, v[:, 0]) == pytest.approx(dense.T @ (dense @ v[:, 0]), abs=1e-9)
    assert blocks.count() == 4 and blocks.agg(F.sum("square")).first()[0] == pytest.approx((dense**2).sum())
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_prefixes_and_capped_minorities(spark):
    rows = votes(spark, [(f"s{i:02}", p, -1 if i % 2 else 1) for i in range(10) for p in ("a", "b")])
    assert {r["session_id"] for r in evaluate.first_sessions(rows, 4).collect()} == {f"s{i:02}" for i in range(4)}
    left = sorted((r["session_id"], r["opinion_id"]) for r in evaluate.minority_capped(rows, "a", -1).collect() if r["value"] == -1)
    assert left == [("s01", "a"), ("s01", "b"), ("s03", "a"), ("s03", "b"), ("s05", "a"), ("s05", "b"), ("s07", "b"), ("s09", "b")]


def test_dumps_show_what_they_may(spark):
    rows = spark.range(1, 251).select(F.col("id").alias("seq"), F.lit("x").alias("id"), F.lit("active").alias("phase"), F.lit("secret").alias("token_hash"))
    page = moderation.dump("sessions", rows, "seq", 0)
    assert page.columns == ["cursor", "id", "phase", "next"] and [r["next"] for r in page.collect()] == [100] * 100
    assert [r["next"] for r in moderation.dump("sessions", rows, "seq", 200).collect()] == [None] * 50
    assert "token_hash" in moderation.dump("votes", rows, "seq", 0).columns
    for bad in (("passwords", 0), ("votes", -1)):
        with pytest.raises(ValueError):
            moderation.dump(bad[0], rows, "seq", bad[1])
    assert len(moderation.dump("votes", rows, "seq", 150).collect()) == 100 and moderation.dump("votes", rows, "seq", 250).collect() == []


def test_seed_and_fixture(spark, tmp_path):
    import json

    from ballotry.sources import seed

    doc = {"tags": [{"id": "t", "label": "T", "description": ""}], "sources": [{"id": "s", "title": "S", "url": "u", "note": ""}], "opinions": [{"id": f"o{i}", "tagId": "t", "text": "x" * 10, "kind": "seed", "sourceIds": ["s"]} for i in range(3)]}
    (tmp_path / "seed.json").write_text(json.dumps(doc, indent=1))
    read = seed.read_seed(spark, str(tmp_path / "seed.json"))
    assert {n: d.count() for n, d in read.items()} == {"tags": 1, "opinions": 3, "sources": 1}
    assert read["opinions"].first()["source_ids"] == ["s"] and read["opinions"].columns[1] == "tag_id"
    assert {r["id"] for r in seed.missing(read["opinions"].where("id = 'o1'"), read["opinions"]).collect()} == {"o0", "o2"}
    check = lambda *rows: tuple(seed.check_fixture(votes(spark, rows), read["opinions"]).first())
    good = [("s", f"o{i}", i - 1) for i in range(3)]
    assert check(*good) == (True, True, True)
    assert check(*good, ("s", "o0", 2)) == (True, True, False) and check(*good[:2]) == (False, True, True)
    assert check(*good, ("r", "o9", 0)) == (False, True, True) and check(*good, ("r", "o1", 3)) == (True, False, True) and check(*good, ("r", "o1", None)) == (True, False, True)


def test_warm_axes_and_centres(spark):
    """A second run begins from the first one's axes and groups, and ends where a cold one does."""
    rng = np.random.default_rng(11)
    rows = [(s, p, -v if rng.random() < 0.12 else v) for s, p, v in blocks(120, 14)]
    data = votes(spark, rows)
    cold = analysis.analyze(data)
    warm = analysis.analyze(data, previous=cold)
    assert warm.model.warm == (True, True) and not any(cold.model.warm) and sum(warm.model.iterations) < sum(cold.model.iterations)
    assert warm.status == cold.status == "ready" and warm.groups == cold.groups
    for a, b in zip(warm.model.components, cold.model.components, strict=True):
        assert a == pytest.approx(b, abs=1e-5)
    # other opinions: fewer than four fifths are known, so axes begin cold
    other = votes(spark, [(s, p if int(p[1:]) < 9 else f"q{p}", v) for s, p, v in rows])
    assert not any(analysis.analyze(other, previous=cold).model.warm)
    from ballotry.operators import cluster

    points = cluster.with_hashes(cold.points)
    label = cold.points.select("session_id", "group")
    centers = cluster.previous_centers(points, label)
    assert centers == pytest.approx(np.array([[x, y] for x, y, _ in cold.model.centers]), abs=1e-9)
    assert cluster.previous_centers(points, label.where("group = 0")) is None
    assert cluster.previous_centers(points, label.where("group = 0 or session_id = 's0000'"), min_size=100) is None


def test_caches_of_an_analysis_go(spark):
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    assert analysis.analyze(votes(spark, blocks(40))).status == "collecting" and held() == before
    r = analysis.analyze(votes(spark, blocks()))
    assert held() > before and r.points.count() == 100
    r.release()
    assert held() == before


def test_labels_stand_apart(spark):
    assert geometry.place_labels([("a", 100, 100)]) == {"a": (100, 100)}
    at = geometry.place_labels([("a", 100, 100), ("b", 102, 101), ("c", 300, 100)])
    assert at["a"] == (100, 100) and at["c"] == (300, 100) and at["b"] in {(102 + x, 101 + y) for x, y in geometry.LABEL_OFFSETS[1:]}


def test_a_session_posts_three_times(spark):
    rows = spark.createDataFrame([("s", i, f"p{i}") for i in range(5)] + [("r", 9, "q")], "session_id string, seq int, id string")
    assert {r["id"] for r in events.limited_posts(rows).collect()} == {"p0", "p1", "p2", "q"}


def test_few_points_and_many_give_the_same_groups(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(s, p, -v if rng.random() < 0.3 else v) for s, p, v in blocks(120, 14)]
    data, options = votes(spark, rows), analysis.Options(min_silhouette=0.1)
    few = analysis.analyze(data, options=options)
    monkeypatch.setattr("ballotry.operators.cluster.FEW", 0)
    many = analysis.analyze(data, options=options)
    assert few.status == many.status == "ready" and few.groups == many.groups
    a, b = few.diagnostics["candidates"], many.diagnostics["candidates"]
    assert [(k, i, sizes) for k, i, _, sizes in a] == [(k, i, sizes) for k, i, _, sizes in b]
    assert [q for _, _, q, _ in a if q is not None] == pytest.approx([q for _, _, q, _ in b if q is not None], abs=1e-12)
