"""Brute force, round trips and defined cases of the text operators on small tables."""

import hashlib
import os
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotry.llm import decontaminate, exact_dedup, graph, html_text, line_dedup, near_dedup, pii, sentencepiece_codec, token_shards, toxicity, warc
from ballotry.llm.common import model_path, ranks_path, table

DIR = "/root/testdata/sf0.001"
LONG = "x " * 30_000 + "y" * 60_000


def docs(spark, rows):
    """Documents with an extra column whose name clashes with ones the operators make."""
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, keep_id string")


EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, LONG), (5, LONG), (None, "null id"), (6, " \n\t "), (7, "Hé ▁ 日本 <p>&amp;")]


def smallest(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_exact_dedup(spark):
    for limit in (1 << 20, 300):  # the second makes buckets spill and recurse
        rows = exact_dedup.exact_dedup(docs(spark, EDGE), limit=limit).collect()
        assert len(rows) == len(EDGE)
        by = {r["doc_id"]: r for r in rows}
        assert (by[1]["keep_id"], by[1]["kept"], by[1]["group_size"]) == (2, False, 2) and by[4]["keep_id"] == 5
        assert [r["kept"] for r in rows if r["doc_id"] == 3] == [True, True]
        assert by[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_grace_recursion(tmp_path):
    records = [(hash(str(i % 500)), str(i % 500) * 20, i, 1) for i in range(5000)]
    out = {e[1]: (e[2], e[3]) for e in exact_dedup.grace(iter(records), Path(tmp_path), 2000)}
    assert out == {str(k) * 20: (4500 + k, 10) for k in range(500)} and not list(tmp_path.iterdir())


def test_near_dedup_equals_brute_force(spark):
    at = table(spark, DIR, "documents")
    rows = at.select("doc_id", "text").collect()
    shingle = near_dedup.Shingler(2)
    sets = {r[0]: frozenset(shingle(r[1] or "").tolist()) for r in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(pairs, ids)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(at, words=2).collect()}
    assert got == want


def test_near_dedup_large_family_and_edges(spark):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(1)
    family = []
    for i in range(150):
        w = list(words)
        for j in rng.choice(60, rng.integers(1, 7), replace=False):
            w[j] = f"e{i}_{j}"
        family.append((100 + i, " ".join(w)))
    rows = near_dedup.near_dedup(docs(spark, EDGE + family), words=2).collect()
    sets = {i: frozenset(zip(t.split(), t.split()[1:], strict=False)) for i, t in family}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(pairs, sets)
    assert {r["doc_id"]: r["component_id"] for r in rows if (r["doc_id"] or 0) >= 100} == want
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["component_id"] == 4 and by[1]["n_shingles"] == 0 and by[2]["kept"] and by[3]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0


def test_strays_meet_all_members_of_their_bucket(spark):
    """Node 3 is loosely close to an end and node 4 isn't, so they are compared with each other; so are 3 and
    5, which are close to different ends that aren't close themselves."""
    members = spark.createDataFrame([(7, 1), (7, 3), (7, 4), (7, 9), (8, 1), (8, 4), (8, 9), (9, 1), (9, 3), (9, 5), (9, 9), (6, 2), (6, 3), (6, 5), (6, 8)], "key long, node long")
    near = spark.createDataFrame([(3, 1), (1, 3), (9, 5), (2, 8), (3, 2), (5, 8)], "a long, b long")
    found = sorted(tuple(r) for r in graph.orphans(members, near).collect())
    assert found == [(7, 3, False), (7, 4, True), (9, 3, False), (9, 5, True)]


def test_near_dedup_of_pairs_that_only_one_end_knows(spark):
    """A family in a chain: each text shares most with the next, little with those far off."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 60])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=2, threshold=80).collect()}
    assert set(got.values()) == {0}


def test_sketch_concentrates():
    x = np.arange(1000, dtype=np.uint64)
    a, b = near_dedup.sketches([near_dedup.mix(x[:900]), near_dedup.mix(x[100:])], 1000)
    assert abs((a == b).mean() - 0.8) < 0.06
    assert (near_dedup.sketches([near_dedup.mix(x[:2])], 100) != np.iinfo(np.uint64).max).all()


def test_signatures_estimate_similarity():
    """Values agree as often as shingles do; bands of real pairs behave as independent ones; pieces change nothing."""
    rng, letters = np.random.default_rng(3), list("abcdefghijklmnopqrstuvwxyz    ")
    xs = ["".join(rng.choice(letters, 70)) for _ in range(3000)]
    ys = [x[:60] + "".join(rng.choice(letters, 10)) for x in xs]
    sets = [[{t[i : i + 5] for i in range(len(t) - 4)} for t in ts] for ts in (xs, ys)]
    alike = np.array([len(a & b) / len(a | b) for a, b in zip(*sets, strict=True)])
    a, b = line_dedup.signatures(xs), line_dedup.signatures(ys)
    assert abs((a == b).mean() - alike.mean()) < 0.01
    met = (line_dedup.keys_of(a) >> 24 == line_dedup.keys_of(b) >> 24).any(axis=1)
    assert abs(met.mean() - (1 - (1 - alike**line_dedup.ROWS) ** line_dedup.BANDS).mean()) < 0.02
    long = [" ".join(xs), "ab", "abcd", "日本語😀", "x" * 200_000, *xs[:5]]
    whole, size = line_dedup.signatures(long), line_dedup.PIECE
    try:
        for line_dedup.PIECE in (7, 100):
            assert (line_dedup.signatures(long) == whole).all()
    finally:
        line_dedup.PIECE = size


def plain(line):
    low = line.lower()
    return re.sub(r"[^\w]+", " ", low.replace("_", " ")).strip(" ") or low.strip(" ")


def all_shingles(line):
    units = plain(line).encode("utf-16-be")
    return frozenset(units[i : i + 10] for i in range(0, max(1, len(units) - 9), 2))


HEX = [hashlib.sha1(bytes([i])).hexdigest() for i in range(4)]
PAIRS = [
    ("transaction 8841020001 confirmed for customer 7730012345", "transaction 8841097715 confirmed for customer 7730088001", False),
    (HEX[0][:12] + HEX[1][12:], HEX[0][:12] + HEX[2][12:], False), (HEX[3], ("0" if HEX[3][0] != "0" else "1") + HEX[3][1:], True),
    ("----", "====", False), ("Ab.", "ab", True), ("😀😁😂😃", "😀😁😂😄", False),
]


def test_lines_are_verified_whole(spark):
    rows = [(2 * i + k, line_) for i, p in enumerate(PAIRS) for k, line_ in enumerate(p[:2])]
    lines = spark.createDataFrame(rows, "node long, line string").select("node", line_dedup.plain("line").alias("text"))
    edges = lines.where("node % 2 = 1").select(F.col("node").alias("a"), "text", (F.col("node") - 1).alias("b"))
    assert {r["b"] // 2 for r in line_dedup.linked(edges, lines).collect()} == {i for i, (x, y, same) in enumerate(PAIRS) if same}
    sets = {r["node"]: len(line_dedup.shingles(r["text"])) for r in lines.collect()}
    assert sets == {i: len(all_shingles(line_)) for i, line_ in rows}


def test_edges_of_two_directions_are_verified_once(spark):
    """Of an edge and the same one the other way round, one is left; one of a single direction stays, whichever end is lesser."""
    line = "a line of quite some words that all of them have"
    hubs = {1: [2], 2: [1, 3], 3: [], 4: [3], 5: [6], 6: [5]}
    lines = spark.createDataFrame([(i, line if i < 6 else "something else entirely", h) for i, h in hubs.items()], "node long, text string, hubs array<long>")
    edges = lines.select(F.col("node").alias("a"), "text", F.explode("hubs").alias("b"))
    assert sorted(map(tuple, line_dedup.linked(edges, lines).collect())) == [(1, 2), (2, 3), (4, 3)]


def line_keeps(documents):
    """(doc_id, line_no) -> the place that stays, by all pairs that share a shingle."""
    first, every = {}, []
    for i, t in sorted(documents):
        for k, line in enumerate((t or "").split("\n")):
            every.append((i, k, line))
            if line.strip():
                first.setdefault(line, (i, k))
    index, pairs, sets = defaultdict(list), [], {line: all_shingles(line) for line in first}
    for line in sets:
        shared = Counter(o for s in sets[line] for o in index[s])
        pairs += [(first[line], first[o]) for o, n in shared.items() if 100 * n >= 80 * (len(sets[line]) + len(sets[o]) - n)]
        for s in sets[line]:
            index[s].append(line)
    want = smallest(pairs, first.values())
    return {(i, k): want[first[line]] if line.strip() else (i, k) for i, k, line in every}


def test_line_dedup_equals_brute_force(spark):
    at = table(spark, DIR, "documents")
    want = line_keeps(map(tuple, at.select("doc_id", "text").collect()))
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.line_dedup(at).collect()}
    assert got.keys() == want.keys()
    wrong = [at for at in want if got[at] != want[at]]
    assert len(wrong) <= 0.002 * len(want), (len(wrong), len(want))


def test_alike_lines_meet(spark):
    """Families of two, one word of a line replaced, near the threshold; and the pairs above."""
    rng, pairs = np.random.default_rng(5), []
    while len(pairs) < 1500:
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 8))) for _ in range(rng.integers(9, 15))]
        x, k = " ".join(words), rng.integers(len(words))
        y = " ".join([*words[:k], "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)), *words[k + 1 :]])
        a, b = all_shingles(x), all_shingles(y)
        if 80 * len(a | b) <= 100 * len(a & b) <= 87 * len(a | b):
            pairs.append((x, y))
    near = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string")
    assert line_dedup.line_dedup(near).where("not kept and doc_id = keep_doc_id + 1").count() >= 0.95 * len(pairs)
    given = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(PAIRS) for k, x in enumerate(p[:2])], "doc_id long, text string")
    assert {r["doc_id"] // 2 for r in line_dedup.line_dedup(given).where("not kept").collect()} == {i for i, p in enumerate(PAIRS) if p[2]}


def test_family_with_a_strange_hub_is_whole(spark):
    """Lines that share a bucket with one that is like none of them are still compared."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    rows = [(i, " ".join([*words[:25], words[30 + i], *words[25:30]])) for i in range(300)]
    out = line_dedup.line_dedup(docs(spark, rows))
    assert out.where("kept").count() == 1 and out.where("class_size = 300 and keep_doc_id = 0").count() == 300


def test_promising_rows_are_those_with_an_agreeing_partner(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i % 7), i, int(rng.integers(1 << 6)) * 0o1010101 ^ int(rng.integers(1 << 24)), int(rng.integers(4)), bool(rng.random() < 0.3)) for i in range(700)]
    digits = lambda key: [key >> 3 * i & 7 for i in range(8)]
    alike = lambda x, y: sum(a == b for a, b in zip(digits(x), digits(y), strict=True)) >= line_dedup.AGREE
    want = {z[1] for x in rows if x[4] for y in rows if x[0] == y[0] and x[3] != y[3] and alike(x[2], y[2]) for z in (x, y)}
    groups = spark.createDataFrame(rows, "group long, node long, key long, component long, stray boolean")
    assert 0 < len(want) < len(rows) and {r["node"] for r in line_dedup.promising(groups).collect()} == want
    assert line_dedup.promising(groups.limit(0)).count() == 0


def test_blocks_of_lines_equal_all_pairs(spark):
    """The forest of verified edges joins the same components as all pairs of a group do."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(60)]
    lines = [" ".join([*rng.permutation(words[:20])[:2], *words[20:35], *rng.permutation(words[:20])[:1]]) for _ in range(400)]
    rows = [(i % 7, i, i if i % 3 else i % 21, bool(i % 3)) for i in range(400)]
    sets = [all_shingles(line_) for line_ in lines]
    alike = lambda x, y: 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    pairs = [(x[2], y[2]) for x in rows if x[3] for y in rows if x[0] == y[0] and x[2] != y[2] and alike(x[1], y[1])]
    groups = spark.createDataFrame(rows, "group long, node long, component long, stray boolean")
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, text string")
    found = [tuple(r) for r in near_dedup.block_links(groups, texts, lambda: line_dedup.shingles, 80).collect()]
    parts = {r[2] for r in rows}
    assert set(found) <= {*pairs, *((b, a) for a, b in pairs)} and len(found) < len(pairs)
    assert smallest(found, parts) == smallest(pairs, parts)
    assert near_dedup.block_links(groups.limit(0), texts, lambda: line_dedup.shingles, 80).count() == 0


def test_rows_of_one_doc_id_lose_their_own_lines_only(spark):
    line, other = "A line of quite some words that comes again and again here.", "Nothing like this stands in any different place of them."
    rows = [(1, line), (7, f"{line}\nthe rest of the first row"), (7, f"{other}\nan end of the second one")]
    out = sorted(r["text"] for r in line_dedup.drop_duplicate_lines(docs(spark, rows)).collect())
    assert out == sorted([line, "the rest of the first row", rows[2][1]])


def test_line_dedup_runs_no_python_on_executors(spark, monkeypatch):
    """All its steps, its graph's too, are DataFrame functions, whichever steps the lines need."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    at = docs(spark, [(i, " ".join([*words[:25], words[30 + i], *words[25:30]])) for i in range(60)])

    def never(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(at), name, never)
    assert line_dedup.line_dedup(at).where("class_size = 60 and keep_doc_id = 0").count() == 60


def test_lines_of_all_lengths_meet(spark):
    """One signature for short lines, another for long ones; a pair may lie on both sides."""
    rng, rows = np.random.default_rng(6), []
    for n in (12, 20, 28, 34, 38, 44, 60, 120, 300):
        for _ in range(100):
            x = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n + 4))
            rows += [(len(rows), x), (len(rows) + 1, x + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n // 5)))]  # n shared of 1.2 n at most
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("not kept and doc_id = keep_doc_id + 1")
    found = {r["doc_id"] // 200 for r in out.collect()}
    assert len(found) == 9 and out.count() >= 0.97 * len(rows) / 2


def test_line_dedup_keeps_no_shuffles(spark):
    """What its steps shuffled and the table of lines are gone before its result is read; the session is as before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {n for d in disk.localDirs() for _, _, ns in os.walk(d.getPath()) for n in ns if n.startswith("shuffle_") and n.endswith(".data")}
    name, old = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    was = spark.conf.get(name, None)
    line_dedup.line_classes(docs(spark, [(i, f"a line of some words that differ in their end {i % 7}\nanother {i}") for i in range(40)]))
    for _ in range(50):
        if not shuffles() - old:
            break
        time.sleep(0.1)
    assert not shuffles() - old and spark.conf.get(name, None) == was
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [n for at in os.listdir(folder) if at.startswith("lines-") for n in os.listdir(f"{folder}/{at}") if not n.startswith(".")]


def test_line_dedup_edges(spark):
    line = "A line of quite some words that comes again and again here."
    rows = [(1, f"start of one document here\n{line}"), (2, f"{line}\n\nanother ending of the text\n"), (3, line), (3, line), (None, line), (4, None), (5, "short\nshort"), (6, LONG)]
    at = docs(spark, rows).withColumnsRenamed({"keep_id": "gone_0"}).withColumns({"gone_1": F.lit(1), "line_no": F.lit(2), "node": F.lit("n"), "kept": F.lit(False)})
    left = line_dedup.drop_duplicate_lines(at)
    assert left.columns == at.columns
    out = {r["doc_id"]: r["text"] for r in left.collect()}
    assert out == {1: rows[0][1], 2: "\nanother ending of the text\n", None: line, 4: None, 5: "short", 6: LONG}
    found = line_dedup.line_dedup(at).collect()
    assert {(r["doc_id"], r["line_no"]): r["kept"] for r in found if r["doc_id"] in (2, 4, 5)} == {(2, 0): False, (2, 1): True, (2, 2): True, (2, 3): True, (4, 0): True, (5, 0): True, (5, 1): False}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("task_rows", [3_000, 200_000])
def test_components_of_a_chain_in_few_rounds(spark, monkeypatch, task_rows):
    from ballotry.llm import graph

    runs, packed = [], graph.packed
    monkeypatch.setattr(graph, "packed", lambda df: runs.append(1) or packed(df))
    monkeypatch.setattr(graph, "TASK_ROWS", task_rows)
    chain = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [tuple(r) for r in graph.components(chain).groupBy("component").count().collect()] == [(0, 10_001)]
    assert len(runs) <= 2 + 2 * 20
    few = spark.createDataFrame([(5, 3), (3, 9), (7, 8), (None, 3), (4, 4), (5, 3)], "a long, b long")
    assert sorted(map(tuple, graph.components(few).collect())) == [(3, 3), (5, 3), (7, 7), (8, 7), (9, 3)]
    assert graph.components(few.limit(0)).count() == 0


def brute_windows(documents, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    index = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            index[tuple(w[k : k + window])].add("null" if i is None else str(i))
    out = []
    for i, t in documents:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in index}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in index:
                    found |= index[tuple(w[k : k + n])]
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [50_000, 40])
def test_decontamination(spark, block):
    items = [*map(tuple, table(spark, DIR, "benchmark").select("item_id", "text").collect()), (900, "one"), (901, None), (902, "..."), (None, "x x"), (903, "x " * 12)]
    rows = [*map(tuple, table(spark, DIR, "documents").select("doc_id", "text").collect()), *EDGE[:4], (5, "ONE two x x " + "x " * 15)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, rows), bench, block_windows=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in got), key=str) == brute_windows(rows, items)
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


def test_warc_round_trip(spark):
    same = "<p>" + "ü" * 60
    rows = [(1, "http://a/\r\nX: y", same), (2, None, same), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (None, "n", same), (6, "l", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(spark, pages).collect()}
    assert len(got) == len(rows)
    assert (got[2]["record_type"], got[2]["refers_to"], got[None]["refers_to"], got[1]["record_type"]) == ("revisit", 1, 1, "response")
    assert got[4]["record_type"] == "response" and got[5]["payload_bytes"] == 0
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_notices_damage():
    import zlib

    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    pack = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()
    good = pack(raw) * 3
    assert [p for *_, p in warc.read_records((good[i : i + 7] for i in range(0, len(good), 7)), True)] == [b"payload"] * 3
    for bad in (pack(raw.replace(b"payload\r", b"pAyload\r")), good[:-9], pack(raw[:-6]), pack(raw + b"x")):
        with pytest.raises(ValueError):
            list(warc.read_records([bad]))


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
      <nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice">We use cookies, as you know. Accept?</div>
      <article><h1>Head &amp; line</h1><p><b>First   part.<br><p>Second &lt;part&gt;, longer.</p><form><label>Mail</label></form><div class="ad">Buy this now, it is cheap.</div><p>Last.</article>
      <div id=comments><p>I read this and it is very good, thank you!</p></div><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "Head & line\nFirst part.\nSecond <part>, longer.\nLast."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    rows = html_text.extract(table(spark, DIR, "pages")).collect()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    source = {r[0]: r[1] for r in table(spark, DIR, "pages").select("page_id", "html").collect()}
    for r in rows:  # on these pages the article element holds the text
        import html

        body = re.search(r"<article>(.*?)(</article>|\Z)", source[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", body))
        assert r["text"] == "\n".join(p for p in parts if p)


TEXT = "<p>This is a real paragraph of the article, with enough words, commas and a full stop.</p><p>And here is another one, which says something more, as one does.</p>"
WANT = re.sub("</p>$", "", re.sub("^<p>", "", TEXT)).replace("</p><p>", "\n")


@pytest.mark.parametrize("page", [
    f"<body><article><svg class='i'/>{TEXT}</article></body>", f"<body><object data=x><article>{TEXT}</article></body>", f"<style-guide><article>{TEXT}</article></style-guide>",
    f"<body class='no-sidebar single-post'><div>{TEXT}</div></body>", f"<body><form action=x>{TEXT}</form></body>", f"<noscript>{TEXT}</noscript><svg><text>x</text></svg><article>{TEXT}</article>",
    f"<article>{TEXT}</article><script>var cut = '<p>off", f"<div class='layout has-comments'>{TEXT}</div>",
])
def test_html_keeps_articles_of_ordinary_pages(page):
    assert html_text.main_text(page) == WANT


NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
FOOT = "<footer>Copyright, all rights reserved.</footer>"


@pytest.mark.parametrize("start", [
    "<article class='post category-social'>", "<article class='post comments-open'>", "<article class='post share-buttons-enabled'>", "<article class='entry form-group'>", "<article class='story promo-free'>",
    "<div class='post share-on'>", "<div class='article-form'>", "<main class='content has-sidebar tag-ads'>", "<article class='format-comment'>", "<div class='post type-notice comments-closed'>",
])
def test_html_keeps_articles_whose_class_has_a_bad_part(start):
    page = f"<html><body>{NAV}{start}{TEXT}</{start[1:].split()[0]}>{FOOT}</body></html>"
    assert html_text.main_text(page) == WANT
    if "article-form" in start:
        page = page.replace(FOOT, "<p>One other paragraph beside it, which is long enough to be of the text.</p>" + FOOT)
        assert html_text.main_text(page) == WANT + "\nOne other paragraph beside it, which is long enough to be of the text."


@pytest.mark.parametrize("start", ["<section id='comments'>", "<aside class='sidebar'>", "<div class='comment-list'>", "<div class='post-comments'><div class='comment'>", "<aside class='related-posts'>"])
@pytest.mark.parametrize("main", ["<article>", "<div>", "<main>"])
def test_html_leaves_out_comments_and_teasers_that_are_articles(start, main):
    many = "".join(f"<article><p>Reader {i} says that this was a good text, and much too short, as always.</p></article>" for i in range(8))
    kind = main[1:-1]
    page = f"<body>{NAV}{main}<h1>A heading</h1>{TEXT}</{kind}>{start}{many}</{start[1:].split()[0]}>{FOOT}</body>"
    assert html_text.main_text(page) == "A heading\n" + WANT


def test_html_leaves_controls_out_of_lines():
    assert html_text.main_text("<article><p>Some text here, <button>Share</button>and more of it.</p><p>Last <select><option>a</select>words, in one line.</p></article>") == "Some text here, and more of it.\nLast words, in one line."
    assert html_text.main_text(f"<p>This stays, as it is, <button>open {TEXT}") == "This stays, as it is, open\n" + WANT


def test_html_of_deep_and_long_pages():
    import time

    began = time.process_time()
    html_text.main_text("<div>x" * 20_000), html_text.main_text("<b>" * 20_000 + TEXT), html_text.main_text("</i></div>" * 50_000)
    assert html_text.main_text("<p>some text here, as it is.</p>" * 20_000).count("\n") == 19_999
    assert html_text.main_text("<div>" * 20_000 + TEXT) == WANT
    assert time.process_time() - began < 30


def test_html_rows(spark):
    rows = [(1, "u", f"<article>{TEXT}</article>", 7), (1, "u", f"<article>{TEXT}</article>", 7), (2, None, None, 7), (None, "n", "", None), (3, "u", f"<article>{TEXT * 3000}</article>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    long = "\n".join([WANT] * 3000)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "n", "", 0), (3, "u", long, len(long))], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_minimum_cut():
    to, room, edges = [], [], [[] for _ in range(4)]
    for u, v, c in ((0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 4)):
        edges[u].append(len(to)), edges[v].append(len(to) + 1)
        to += [v, u]
        room += [c, 0]
    html_text.flow(to, room, edges, 0, 3)
    assert sum(room[e ^ 1] for e in edges[0]) == 5


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_personal_data(spark):
    tricky = [
        (10, "é@x a@b.c_d@e.f.g x@y.z. 1.2.3.4.5 999.1.1.1 0007.2.3.255 +49 (0)30 1234567- 4111 1111 1111 1111 ünï 4111-1111-1111-1112"),
        (11, "1" * 3000 + " " + "a" * 3000 + "@b" + ".c" * 4000), (12, "a@b.c@d.e +1 (555) 555-1234 Mr. John Smith call 555-123-4567 mail joe [at] x [dot] com"),
    ]
    rows = [*map(tuple, table(spark, DIR, "documents").select("doc_id", "text").collect()), *((i + 10**6 if i else None, t) for i, t in EDGE), *((i + 10**7, t) for i, t in tricky)]
    got = pii.personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        base = brute_spans(t or "")
        assert by[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), base
        assert by[i]["n_ip"] == base.count("ip:") and set(filter(None, base.split(","))) <= set(by[i]["spans"].split(","))
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_reliabilities_find_the_good_labeler():
    rng = np.random.default_rng(0)
    counts = Counter()
    for _ in range(4000):
        true = rng.random() < 0.5
        votes = tuple(int((1 if true else -1) * (1 if rng.random() < p else -1)) for p in (0.95, 0.9, 0.85, 0.5, 0.8, 0.55))
        counts[0, votes] += 1
    _, table_, _ = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert table_[0, 1, 2] > 0.9 and abs(table_[3, 1, 2] - 0.5) < 0.1


def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = ["", "  a  b ", "\n x", " ", "   ", "▁a", "▁▁ x▁", "a▁", "Ｈｅ ﬁ é́ ​\x00x", "<s> </s>", LONG]
    rows = [*((i, t) for i, t in enumerate(texts)), (99, None), *((r[0] + 1000, r[1]) for r in table(spark, DIR, "documents").select("doc_id", "text").collect())]
    got = sentencepiece_codec.encode(docs(spark, rows), model_path()).collect()
    assert len(got) == len(rows)
    source = dict(rows)
    for r in got:
        text = source[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(r["ids"])
        if r["ids"]:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text.encode()) and r["ends"][:-1] == r["starts"][1:]


def test_queries_give_spans_of_every_document(spark):
    import sentencepiece

    from ballotry.llm import queries

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    source = {r[0]: r[1] for r in table(spark, DIR, "documents").select("doc_id", "text").collect()}
    for r in queries.op9_sentencepiece(spark, DIR).collect():
        raw, ids, bounds, at = (source[r["doc_id"]] or "").encode(), library.encode(source[r["doc_id"]] or ""), [], 0
        for k, i in enumerate(ids):  # walk the source: a marker is a space, but the one in front isn't there
            piece = library.id_to_piece(i)
            n = 1 if library.is_byte(i) else len(piece.replace("▁", " ").encode())
            end = at + n - (k == 0 and piece.startswith("▁"))
            bounds.append(f"{at}:{end}")
            at = end
        assert at == len(raw) and r["spans_sha256"] == hashlib.sha256(",".join(bounds).encode()).hexdigest()


@pytest.mark.parametrize("bounds", [[], [0], [0, 0], [0, 3, 7], [5, 65_534, 65_535, 65_536, 70_000], list(range(0, 9 << 15, 11))])
def test_spans_in_decimal(bounds):
    want = ",".join(f"{x}:{y}" for x, y in zip(bounds, bounds[1:]))  # noqa: B905
    assert sentencepiece_codec._decimal(np.array(bounds, np.int64)) == want


def test_alignment_of_replaced_and_squeezed_text():
    own = sentencepiece_codec.Codec(model_path())
    assert own.normalise("a▁b")[1].tolist() == [0, 1, 4, 5]
    own.squeeze = True
    normal, align = own.normalise("  a ▁ b ")
    assert normal == "a   b" and align.tolist() == [2, 3, 4, 7, 8, 9]


def test_character_map():
    # a trie of one entry: "ab" -> "c"; units as a double array lays them out
    units = [0] * 512
    units[0] = (1 << 10)  # root, offset 1
    units[1 ^ ord("a")] = ord("a") | (200 << 10)
    second = 1 ^ ord("a") ^ 200 ^ ord("b")
    units[second] = ord("b") | (1 << 8) | (3 << 10)
    units[second ^ 3] = 0x80000000
    blob = (4 * len(units)).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"c\0"
    found = sentencepiece_codec.CharacterMap(blob)
    assert found.longest(b"xaby", 1) == (2, b"c") and found.longest(b"xaay", 1) is None


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel(n):
    f = token_shards.Feistel(n, "k")
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (f.inverse(slots) == np.arange(n)).all()


def test_training_order(spark, tmp_path):
    docs(spark, [*EDGE, (8, "a  b\n\nc")]).repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    manifest = token_shards.materialise(rows, ranks_path(), length=64, per_shard=50)
    found = {r["slot"]: r for r in token_shards.read(manifest, 64).collect()}
    order = token_shards.Feistel(len(found), "0")
    stream = [i for s in order.slot(np.arange(len(found))) for i in found[s]["ids"] if i != token_shards.PAD]
    texts, now = [], []
    for i in stream:
        if i == token_shards.END:
            texts.append(token_shards.encoding(ranks_path()).decode(now))
            now = []
        else:
            now.append(i)
    assert texts == [r["text"] or "" for r in rows.collect()] and sorted(found) == list(range(len(found)))
    assert token_shards.read(manifest, 64, from_slot=70).count() == len(found) - 70
    assert token_shards.materialise(rows.limit(0), ranks_path()).count() == 0


def test_training_order_encodes_once(spark):
    """Texts that differ whenever they are read are written as they were encoded, in several passes over
    what was kept, which goes in the end."""
    noisy = F.udf(lambda i: f"text {i} {os.urandom(40).hex()}").asNondeterministic()
    manifest = token_shards.materialise(spark.range(0, 200, 1, 3).select(noisy("id").alias("text")), ranks_path(), length=32, per_shard=7)
    found = {r["slot"]: r["ids"] for r in token_shards.read(manifest, 32).collect()}
    assert manifest.count() == -(-len(found) // 7) > 2 * token_shards.PASSES and sorted(found) == list(range(len(found)))
    stream = [i for s in token_shards.Feistel(len(found), "0").slot(np.arange(len(found))) for i in found[s] if i != token_shards.PAD]
    texts = bytes(token_shards.encoding(ranks_path()).decode_bytes([i for i in stream if i != token_shards.END])).decode()
    assert re.sub(" [0-9a-f]{80}", " ", texts) == "".join(f"text {i} " for i in range(200)) and stream.count(token_shards.END) == 200
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [n for n in os.listdir(folder) if n.startswith("sequences-")]


def test_toxicity(spark):
    at, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.toxicity(at, labels).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert got > 0.9
    plain = [f"the {a} near {b} today." for a in ("weather", "garden", "window", "river") for b in ("stone", "paper", "forest", "market", "harbour")]
    model = toxicity.fit([t.replace("near", "idiot") for t in plain] + plain, [1] * 20 + [0] * 20)
    score = lambda t: model.score(model.margin(w := toxicity.tokens_of(t), model.learn(set(w))))
    for text in ("an idiot", "an id.iot", "an i d i o t", "AN IDIOT!"):
        assert score(text) > 0.5, text
    assert score("an idxiot") > 20 * score("the fine weather")
    assert score("the fine weather") < 0.5 and 0 <= score("") <= 1
    rows = toxicity.toxicity(docs(spark, EDGE), spark.createDataFrame([(1, None), (3, 1)], "doc_id long, toxic int")).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, DIR).collect()
    at = table(spark, DIR, "documents")
    ids = {r[0] for r in at.select("doc_id").collect()}
    assert 0 < len(out) < len(ids) and {r["doc_id"] for r in out} <= ids
    toxic = {r["doc_id"] for r in toxicity.toxicity(at, table(spark, DIR, "labels")).where("predicted = 1").collect()}
    assert not toxic & {r["doc_id"] for r in out}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "sentencepiece"]


def test_line_shuffles_are_dealt_by_the_size_of_the_input(spark):
    from ballotry.llm.common import dealt_by_size

    name, most = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    old, size = spark.conf.get(name), spark.conf.get(most)
    seen = []

    def inside(docs):
        with dealt_by_size(docs):
            seen.append(spark.conf.get(name))

    try:
        for value in ("128m", "134217728b", "134217728", "16m", "1g"):
            spark.conf.set(most, value)
            inside(spark.range(0, 40, 1, 40))
        inside(spark.range(0, 1, 1, 1).where("id < 0"))
        assert seen == ["320", "320", "320", "40", "2560", "64"] and spark.conf.get(name) == old
    finally:
        spark.conf.set(most, size)
