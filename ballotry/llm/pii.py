"""Operator 8: personal data by weakly supervised span labelling, with DataFrame functions.

Candidate spans come from patterns: the four base kinds (email, ip, card, phone), national
phone numbers, spelled-out e-mail addresses, account numbers and titled names. Labelers
vote on each candidate (1, -1, or 0 to abstain): the kind's own check, a gazetteer (top-level
domains, card issuers, calling codes, reserved address ranges, country codes, given names),
words before the span that speak for or against it, its edges, and its usual length. Votes are counted by
pattern, at most a few thousand rows whatever the input, and expectation-maximisation on
these counts estimates each labeler's reliability and the share of true spans of each kind.
A logistic classifier over votes and kind is then trained on the soft labels, and applied to
the candidates as one column expression. Base matches that pass their check always stay;
others are added where the classifier says so and they touch no base span.

Offsets are code points. Regular expressions give matches but no places, so places are
running sums over the pieces between the matches. Patterns are written so that no word is
scanned again from each of its characters and no repetition recurses, as texts can be long.

Defined cases: null or empty text has no spans; repeated rows are labelled each; without
any candidate the classifier is not needed; an empty table gives an empty one; other columns
aren't looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Kinds in the order they are listed, the base ones first, with their patterns.
#: A possessive repetition or a look-behind changes no match here; it only avoids rescanning.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![\w-])",
    "spelled_email": r"(?i)(?<![\w.])[a-z0-9._-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,64}+ ?[\[(] ?dot ?[\])] ?[a-z]{2,12}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "name": r"(?<![\w])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Monsieur|Señor|Señora)\.?\x20[A-ZÀ-Ý][\p{L}'-]{1,30}+(?:\x20[A-ZÀ-Ý][\p{L}'-]{1,30}+)?",
}
BASE = 4
#: Characters without which a pattern can't match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "local_phone": r"[0-9]{3}[.-][0-9]{4}", "spelled_email": r"(?i)[\[(] ?at", "account": r"[A-Z]{2}[0-9]{2}", "name": r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Monsieur|Señor|Señora)\.?\x20"}
#: Gazetteers and context words.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl"]
CALLING = ["1", "33", "34", "39", "41", "43", "44", "49", "52", "54", "55", "61", "81", "86", "91"]
COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
GIVEN = ["Anna", "Carlos", "Clara", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "José", "Juan", "Laura", "Lucas", "Maria", "Marie", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sophie", "Thomas"]
FOR = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo", "ip": "address|host|server|client|from|login|adresse", "card": "card|visa|master|credit|karte|carte|tarjeta|pay", "phone": "tel|phone|call|fax|mobile|handy|anruf|portable|llam", "local_phone": "tel|phone|call|fax|mobile|handy|anruf|portable|llam",
    "spelled_email": "mail|contact|write|reach|kontakt|courriel|correo", "account": "iban|account|bank|konto|compte|cuenta", "name": "dear|contact|by|from|signed|sincerely|lieb|cher|estimad",
}
AGAINST = r"version|\bv$|isbn|issn|order|sku|\bid\b|ref|token|hash|key|build|release|section|\bno\.?$|[=#]\s*\"?$"
VOTES = ("check", "gazetteer", "for", "against", "edges", "length")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(pieces, 1, F.greatest(F.size(hits), F.lit(0))), lambda m, p: F.struct(m.alias("m"), (F.length(p)).alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def step(done: Column, pair: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + pair["gap"]
        return F.concat(done, F.array(F.struct(start.alias("start"), (start + F.length(pair["m"])).alias("end"), pair["m"].alias("m"))))

    return F.aggregate(pairs, none, step)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_right = F.reverse(number)
    value = lambda i: F.substring(from_right, i, F.lit(1)).cast("int") * (2 - i % 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.when(value(i) > 9, value(i) - 9).otherwise(value(i))) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The check of a kind on a match."""
    n = F.length(digits(m))
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(14, 19) & luhn(F.when(n.between(14, 19), digits(m)).otherwise(F.lit("1")))
    return n.between(10, 15) if kind == "phone" else n.between(10, 10) if kind == "local_phone" else F.lit(True)


def votes(kind: str, text: Column, c: Column) -> list[Column]:
    """The labelers' votes on candidate c of a kind, as VOTES names them."""
    m, sure = c["m"], lambda yes: F.when(yes, 1).otherwise(-1)
    n = F.length(digits(m))
    before = F.lower(F.substring(text, F.greatest(c["start"] - 29, F.lit(1)), F.least(c["start"], F.lit(30))))
    left, right = F.substring(text, F.greatest(c["start"], F.lit(1)), F.least(c["start"], F.lit(1))), F.substring(text, c["end"] + 1, F.lit(1))
    known = {
        "email": sure(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)),
        "ip": F.when(m.rlike(r"^(?:0|10|127|255|192\.168|169\.254)\."), -1).otherwise(0),
        "card": sure(m.rlike("^[3-6]")),
        "phone": sure(m.rlike(rf"^\+(?:{'|'.join(CALLING)})")),
        "local_phone": F.lit(0),
        "spelled_email": sure(F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(DOMAINS)),
        "account": sure(F.substring(m, 1, 2).isin(COUNTRIES)),
        "name": F.when(F.arrays_overlap(F.split(m, " "), F.array(*map(F.lit, GIVEN))), 1).otherwise(0),
    }[kind]
    usual = {"card": n.between(15, 16), "phone": n.between(11, 13), "ip": F.length(m) >= 7, "email": F.length(m) <= 64}.get(kind, F.lit(True))
    return [sure(passes(kind, m)), known, F.when(before.rlike(FOR[kind]), 1).otherwise(0), F.when(before.rlike(AGAINST), -1).otherwise(0), sure(~left.rlike(r"[\w@#/=]") & ~right.rlike(r"[\w@/]")), sure(usual)]


def _describer(kind: str, number: int, text: Column):  # noqa: ANN202
    def describe(c: Column) -> Column:
        own = [v.cast("int").alias(n) for n, v in zip(VOTES, votes(kind, text, c), strict=True)]
        base = passes(kind, c["m"]) if number < BASE else F.lit(False)
        return F.struct(c["start"].alias("start"), F.lit(number).alias("kind"), c["end"].alias("end"), base.alias("base"), *own)

    return describe


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): an array of struct(start, kind, end, base, check, gazetteer, ...) a row."""
    text, kinds = F.col(text_col), []
    for number, (kind, pattern) in enumerate(KINDS.items()):
        kinds.append(F.when(text.rlike(NEEDS[kind]), F.transform(spans(text, pattern), _describer(kind, number, text))))
    every = F.flatten(F.array_compact(F.array(*kinds)))
    return text_or_empty(docs, id_col, text_col).select(id_col, every.alias("found"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (kind, votes, count): the probability that
    each pattern's spans are true, each labeler's vote probabilities given the truth
    (labeler, truth, vote + 1), and the share of true spans of each kind."""
    kind = np.array([c[0] for c in counts])
    vote = np.array([c[1] for c in counts]) + 1
    n = np.array([c[2] for c in counts], float)
    true = 1 / (1 + np.exp(-(vote - 1).sum(axis=1)))
    for _ in range(rounds):
        table = np.ones((vote.shape[1], 2, 3))
        for j in range(vote.shape[1]):
            for v in range(3):
                table[j, 1, v] += (n * true)[vote[:, j] == v].sum()
                table[j, 0, v] += (n * (1 - true))[vote[:, j] == v].sum()
        table /= table.sum(axis=2, keepdims=True)
        prior = np.array([((n * true)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        log = np.log(table)
        odds = np.log(prior / (1 - prior))[kind] + sum(log[j, 1, vote[:, j]] - log[j, 0, vote[:, j]] for j in range(vote.shape[1]))
        true = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return true, table, prior


def train(counts: list[tuple[int, tuple[int, ...], int]]) -> np.ndarray:
    """Weights of the span classifier: for each vote its value and its being cast, for each
    kind a shift; a ridge logistic fit to the soft labels."""
    true, _, _ = reliabilities(counts)
    x = np.array([[*v, *(abs(u) for u in v), *(k == i for i in range(len(KINDS)))] for k, v, _ in counts], float)
    n, w = np.array([c[2] for c in counts], float), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (true - p)) - w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _of_kind(number: int):  # noqa: ANN202
    return lambda c: c["kind"] == number


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id; n_email, n_ip, n_card, n_phone (base spans); found
    (array of start, kind, end, base, probability of the spans that stay, by start, then kind);
    base_sha256 and spans, the base and all spans as kind:start:end, comma-joined."""
    at = cut(candidates(docs, id_col, text_col))
    one = at.select(F.explode("found").alias("c"))
    rows = one.groupBy("c.kind", *(f"c.{v}" for v in VOTES)).agg(F.count("*").alias("n")).collect()
    counts = sorted((r[0], tuple(r[1:-1]), r[-1]) for r in rows)
    weights = train(counts).tolist() if counts else [0.0] * (2 * len(VOTES) + len(KINDS))

    def probability(c: Column) -> Column:
        z = F.element_at(F.array(*(F.lit(w) for w in weights[2 * len(VOTES) :])), c["kind"] + 1)
        for v, w, u in zip(VOTES, weights, weights[len(VOTES) :], strict=False):
            z = z + F.lit(w) * c[v] + F.lit(u) * F.abs(c[v])
        return 1 / (1 + F.exp(-z))

    judged = F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"), probability(c).alias("probability")))
    at = at.select(id_col, F.array_sort(judged).alias("found"))
    at = at.withColumn("_base", F.filter("found", lambda c: c["base"]))
    free = lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    at = at.withColumn("found", F.filter("found", lambda c: c["base"] | ((c["probability"] >= 0.5) & free(c))))
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda col: F.array_join(F.transform(col, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")
    return at.select(
        id_col, *(F.size(F.filter("_base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(list(KINDS)[:BASE])),
        F.sha2(told("_base"), 256).alias("base_sha256"), told("found").alias("spans"), "found",
    )


def describe_reliability(table: np.ndarray) -> dict[str, float]:
    """How much a positive vote of each labeler raises the log odds of a true span."""
    return {name: round(math.log(table[j, 1, 2] / table[j, 0, 2]), 3) for j, name in enumerate(VOTES)}
