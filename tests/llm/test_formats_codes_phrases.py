"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ballotry.llm import chat_format as chat
from ballotry.llm import collocations as co
from ballotry.llm import vector_codes as vc

# Chat formatting

CONV = "conv_id long, turn long, role string, text string, formatted string, example int"


def said(spark, rows):
    found = chat.read_back(chat.expand(spark.createDataFrame([(*r, "x", 7) for r in rows], CONV)))
    return {r["conv_id"]: ([tuple(t) for t in r["turns"]], list(r["replies"]), r["formatted_chars"]) for r in found.collect()}


NASTY = ["", "\\", "<", "<\\|im_end|>", "<|im_end|>", "</s>[INST] ok [/INST]", "<|im_<|im_end|>end|>", "[\\\\INST]x[\\INST]", "\n\t ", "<|im_start|>user<|im_sep|>", "a<|im_end|", "é😀</s>", "$1\\2"]


def test_chat_round_trip(spark):
    rows = [(i, j, role, a) for i, a in enumerate(NASTY) for j, role in enumerate(("system", "user", a, "assistant", "user", "assistant"))]
    for i, (turns, replies, _) in said(spark, rows).items():
        assert turns == [(r[2], r[3]) for r in rows if r[0] == i]
        assert replies == [NASTY[i]] * (3 if NASTY[i] == "assistant" else 2)


def test_chat_escape_leaves_no_control_string(spark):
    at = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat.escape("t").alias("e")).collect()
    assert not [r for r in at if any(c in r["e"] for c in chat.CONTROLS)]
    assert [r["t"] for r in at if r["t"] == r["e"]] == [t for t in NASTY if not re.search(r"[<\[]\\*(\|im_(start|sep|end)\|>|/?s>|/?INST\])", t)]
    with pytest.raises(ValueError):
        chat.escape("t", ["<s>"])
    with pytest.raises(ValueError):
        chat.escape("t", [*chat.CONTROLS, "<a<"])


def test_chat_examples(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "dd"), (1, 4, "user", "e")]
    found = chat.expand(spark.createDataFrame([(*r, "x", 7) for r in rows], CONV)).orderBy("example").collect()
    whole = "".join(f"<|im_start|>{r}<|im_sep|>{t}<|im_end|>" for _, _, r, t in rows)
    assert [r["example"] for r in found] == [1, 3, 4] and found[2]["formatted"] == whole and [r["last"] for r in found] == [False, False, True]
    assert [whole.startswith(r["formatted"]) for r in found] == [True] * 3
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] if r["loss_start"] is not None else None for r in found] == ["b", "dd", None]


def test_chat_cases(spark):
    found = said(spark, [(1, 0, None, None), (1, None, "user", "first"), (1, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "user", "y"), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "user", "less")])
    assert found[1][:2] == ([("user", "first"), ("", ""), ("assistant", "")], [""])
    assert found[None][:2] == ([("user", "x"), ("user", "y")], [])
    assert found[2][:2] == ([("user", "less"), ("user", "same"), ("user", "same")], [])
    assert said(spark, []) == {}
    long = "é[INST] " * 300_000
    assert said(spark, [(1, 0, "user", "q"), (1, 1, "assistant", long)])[1][1] == [long]


def test_chat_is_native(spark):
    rows = chat.digests(chat.read_back(chat.expand(spark.createDataFrame([(1, 0, "user", "a", "x", 1)], CONV).where("turn >= 0"))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# Vector codes

VEC = "vec_id long, embedding array<float>, label int, q string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * np.float32(x).item()) for x in v], lab) for i, v, lab, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = [[q[p * w : (p + 1) * w] for p in range(parts)] for _, q, _ in kept]
    starts = {}
    for k in sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1])):
        starts.setdefault(kept[k][0], k)
    books = [[cut[k][p] for k in list(starts.values())[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((dist(v, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for c in cut:
                got.setdefault(near(p, c[p])[1], []).append(c[p])
            for e, vs in got.items():
                books[p][e] = [sum(v[j] for v in vs) // len(vs) for j in range(w)]
    out = []
    for (i, _, lab), c in zip(kept, cut, strict=True):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), lab))
    by = Counter()
    for r in out:
        by[r[3]] += r[2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, err, by[lab], digest) for i, code, err, lab in out), key=str)


def coded(spark, rows, **more):
    found = vc.compress(spark.createDataFrame(rows, VEC).repartition(3), **more).collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found), key=str)


@pytest.mark.parametrize("labels", [100_000, 1])
def test_codes_brute_force(spark, labels):
    rng = random.Random(5)
    rows = [(i, [rng.choice([rng.uniform(-2, 2), 0.5, -0.25, 1000.0 + rng.random() / 4096]) for _ in range(16)], rng.choice([None, 0, 1]), "x") for i in range(120)]
    rows += [(200 + i, rows[0][1], 0, "x") for i in range(40)] + [(7, rows[3][1], 1, "x"), (None, rows[4][1], None, "x"), rows[5]]
    rows += [(300, None, 1, "x"), (301, [1.0] * 15 + [None], 1, "x"), (302, [1.0] * 15 + [math.nan], 1, "x"), (303, [math.inf] + [1.0] * 15, 1, "x"), (304, [], 1, "x")]
    assert coded(spark, rows, most_labels=labels) == brute(rows)


def test_codes_cases(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1, "x")]) == []
    few = [(1, [0.1] * 8, None, "x"), (1, [0.1] * 8, None, "x"), (None, [0.2] * 8, None, "x")]
    assert coded(spark, few) == brute(few)
    assert [r[0] for r in coded(spark, [*few, (9, [0.5] * 16, 1, "x")])] == [1, 1, None]
    with pytest.raises(Exception, match="can't be cut"):
        coded(spark, [(1, [1.0] * 9, 1, "x")])
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, [(1, [1e9] * 8, 1, "x")])


def test_nearest_is_exact_where_floats_are_not():
    rng = np.random.default_rng(3)
    again = 0
    for scale in (3, 4096, 1 << 20, (1 << 27) - 1):
        x, c = (rng.integers(-scale, scale + 1, (k, 8)) for k in (2000, 16))
        c[5], c[9] = c[2], c[2] + 1
        x[:200] = c[2] + rng.integers(0, 2, (200, 8))
        best, n = vc.nearest(x, c)
        again += n
        wide = ((x[:, None].astype(object) - c.astype(object)) ** 2).sum(2)
        assert best.tolist() == [min(range(16), key=lambda e, r=r: (r[e], e)) for r in wide]
    assert again > 0  # some intervals did overlap


# Collocations

DOC = "doc_id long, text string, lang string, f int, phrase string"


def mined(spark, rows, **more):
    found = co.collocations(spark.createDataFrame([(*r, 1, "x") for r in rows], DOC).repartition(4), **more)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def phrases(rows, most=3, least=10, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        if any(g == lang and inside(q) and 100 * b >= 50 * a for (g, q), b in cand.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((g, i + 1, p.decode(), -a, x, y, n[g], -s) for g, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("most,shard,bits", [(3, 1 << 20, 1 << 27), (3, 200, 1 << 15), (2, 300, 1 << 15), (4, 500, 1 << 16)])
def test_collocations_brute_force(spark, most, shard, bits):
    rng = random.Random(most)
    words = ["a", "A", "ab", "é", "éa", "zu", "Ä", "😀", "x-y", "to", "be", "or", "not"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(rng.randrange(60)))
    rows = [(i, text(), rng.choice(["en", "de", None, "und"])) for i in range(150)] + [(200 + i, "New York city new york city, to be or not to be", "en") for i in range(12)]
    assert mined(spark, rows, most=most, shard_bytes=shard, most_bits=bits) == phrases(rows, most)


def test_collocations_cases(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, None, None), (2, "", "en"), (3, " .,", "en")]) == []
    one = [(1, "deep learning! " * 9 + "deep learning", "en")]
    assert mined(spark, one) == phrases(one) and mined(spark, one)[0][2:4] == ("deep learning", 10)
    assert mined(spark, [(1, "a a a a a a a a a a a", "en")]) == phrases([(1, "a a a a a a a a a a a", "en")])
    ties = [(i, "p q. r s. t u", "en") for i in range(10)]
    assert [r[2] for r in mined(spark, ties, top=2)] == ["p q", "r s"]
    long = [(1, "one two three four " * 200_000, "en")]
    assert mined(spark, long) == phrases(long)


def test_collocation_scores_pass_64_bits(spark):
    at = spark.range(1).select(F.lit(3_000_000_000).cast("long").alias("a"))
    wide = F.col("a").cast("decimal(19,0)")
    score = F.call_function("div", (wide * wide).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide * wide)
    assert at.select(score.alias("s")).first()["s"] == 1_000_000


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 500)
    left = np.array([7 - i % 7 if i < 497 else 500 - i for i in range(500)])
    for m in (1, 2, 3, 5):
        want = Counter(tuple(ids[i : i + m]) for i in range(500) if left[i] >= m)
        at, n = co.intervals(ids, left, co.suffix_array(ids, left, m), m)
        assert {tuple(ids[p : p + m]): int(k) for p, k in zip(at, n, strict=True)} == dict(want)


def test_words_of_pieces():
    words, text, left = co.tokenise([b"A bc.", b"", b" d\te\nf"])
    assert words.to_pylist() == [b"a", b"bc", b"d", b"e", b"f"] and text.tolist() == [0, 0, 2, 2, 2] and left.tolist() == [2, 1, 2, 1, 1]
    assert isinstance(words, pa.Array)
