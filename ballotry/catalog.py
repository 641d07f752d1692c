"""All queries of the library over the given tables and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import ballots, bridges, cluster, evaluate, geometry, matrix, moderation, release, routing
from .plans import analysis, ledger, release_build, snapshot
from .sources import adapter as A
from .sources import files, seed
from .sources.adapter import with_views
from .streaming import events as E
from .streaming import sessions
from .streaming.counters import Counters

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c: str) -> F.Column:
    """Six decimals, without a negative zero."""
    return (F.round(c, 6) + 0.0).alias(c)


def _first(s: SparkSession, d: str) -> DataFrame:
    return ballots.first_stored(A.ballots_planted(s, d))


def _last(s: SparkSession, d: str, raw: bool = False) -> DataFrame:
    return ballots.last_valid(A.ballots_raw(s, d) if raw else A.ballots_planted(s, d))


def _eligible_votes(s: SparkSession, d: str, raw: bool = False) -> DataFrame:
    votes = _last(s, d, raw)
    return ballots.of_sessions(votes, ballots.eligible(votes))


FIRST = with_views("planted", "first")
MODEL = with_views("planted", "valid", "eligible", "kept")
ONE_COUNT = "count(*) FILTER (WHERE value = -1) AS agree, count(*) FILTER (WHERE value = 1) AS disagree, count(*) FILTER (WHERE value = 0) AS \"pass\", count(*) FILTER (WHERE value = 2) AS unrelated"


# Encoding and counting


@query(FIRST + f"SELECT opinion_id, {ONE_COUNT} FROM first GROUP BY 1")
def opinion_counts(s: SparkSession, d: str) -> DataFrame:
    return ballots.opinion_counts(_first(s, d))


@query(with_views("planted", "first", "opinions") + "SELECT session_id, count(*) AS n FROM first JOIN opinions ON id = opinion_id AND status = 'approved' GROUP BY 1")
def session_counts(s: SparkSession, d: str) -> DataFrame:
    return ballots.session_counts(_first(s, d), A.opinions(s, d))


@query(with_views("planted", "first", "opinions") + "SELECT count(*) AS votes, count(DISTINCT session_id) AS sessions FROM first JOIN opinions ON id = opinion_id AND status = 'approved'")
def community_totals(s: SparkSession, d: str) -> DataFrame:
    return ballots.community_totals(_first(s, d), A.opinions(s, d))


@query(FIRST + "SELECT session_id, opinion_id, value FROM first")
def dedup_first(s: SparkSession, d: str) -> DataFrame:
    return _first(s, d)


@query(with_views("planted", "valid") + "SELECT session_id, opinion_id, value FROM valid")
def dedup_last(s: SparkSession, d: str) -> DataFrame:
    return _last(s, d)


@query(with_views("planted") + "SELECT session_id, opinion_id, CASE WHEN value = 2 THEN 0 ELSE value END AS stored, value = 2 AS unrelated, value AS shown FROM planted")
def ballot_recode(s: SparkSession, d: str) -> DataFrame:
    at = A.ballots_planted(s, d).select("session_id", "opinion_id", F.when(F.col("value") == 2, 0).otherwise(F.col("value")).alias("stored"), (F.col("value") == 2).alias("unrelated"))
    return at.withColumn("shown", S.recode("stored", "unrelated"))


@query(with_views("planted", "valid", "eligible") + "SELECT * FROM eligible")
def eligible_sessions(s: SparkSession, d: str) -> DataFrame:
    return ballots.eligible(_last(s, d))


@query(MODEL + "SELECT opinion_id, n FROM kept")
def retained_opinions(s: SparkSession, d: str) -> DataFrame:
    return ballots.retained(_eligible_votes(s, d)).select("opinion_id", "n")


@query(MODEL + "SELECT opinion_id, n, s, round(mean, 6) + 0.0 AS mean FROM kept")
def opinion_means(s: SparkSession, d: str) -> DataFrame:
    return ballots.retained(_eligible_votes(s, d)).select("opinion_id", "n", "s", r6("mean"))


@query(FIRST + "SELECT session_id, opinion_id, count(*) AS n FROM lines GROUP BY 1, 2 HAVING count(*) <> 1")
def duplicate_pairs(s: SparkSession, d: str) -> DataFrame:
    return evaluate.duplicates(A.ballots_raw(s, d), ["session_id", "opinion_id"])


@query(with_views("planted", "first") + "SELECT session_id, opinion_id, value FROM first WHERE session_id NOT IN (SELECT session_id FROM first WHERE opinion_id = 'O01')")
def append_new(s: SparkSession, d: str) -> DataFrame:
    """An append that leaves out keys that are stored: here all rows of some sessions."""
    rows = _first(s, d)
    stored = rows.join(rows.where("opinion_id = 'O01'").select("session_id"), "session_id", "left_semi")
    return ballots.append_new(stored, rows, ["session_id", "opinion_id"])


# Review, candidates, routing

_COUNTED = with_views("planted", "first", "opinions", "reports")[:-1] + f", c AS (SELECT opinion_id AS id, {ONE_COUNT} FROM first GROUP BY 1), r AS (SELECT opinion_id AS id, count(*) AS reports FROM reports GROUP BY 1), w AS (SELECT o.id, status, tag_id, author_session, created_at, reviewed_unrelated, reviewed_reports, coalesce(agree, 0) AS agree, coalesce(disagree, 0) AS disagree, coalesce(\"pass\", 0) AS \"pass\", coalesce(unrelated, 0) AS unrelated, coalesce(reports, 0) AS reports FROM opinions o LEFT JOIN c USING (id) LEFT JOIN r USING (id)) "


def _counted(s: SparkSession, d: str) -> DataFrame:
    return moderation.with_counts(A.opinions(s, d), ballots.opinion_counts(_first(s, d)), A.reports(s, d))


@query(_COUNTED + "SELECT id, status, agree, disagree, \"pass\", unrelated, reports FROM w")
def opinions_with_reports(s: SparkSession, d: str) -> DataFrame:
    return _counted(s, d).select("id", "status", "agree", "disagree", "pass", "unrelated", "reports")


@query(_COUNTED + "SELECT id, status, unrelated, reports FROM w WHERE status = 'pending' OR (status = 'approved' AND (unrelated - reviewed_unrelated >= 3 OR reports > reviewed_reports))")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    return moderation.review_queue(_counted(s, d)).select("id", "status", "unrelated", "reports")


@query(with_views("opinions") + "SELECT id, status FROM opinions WHERE status IN ('hidden', 'rejected')")
def hidden_items(s: SparkSession, d: str) -> DataFrame:
    return moderation.hidden(A.opinions(s, d)).select("id", "status")


@query(with_views("reports") + "SELECT opinion_id, category, count(*) AS n FROM reports GROUP BY 1, 2")
def reports_by_category(s: SparkSession, d: str) -> DataFrame:
    return moderation.reports_by_category(A.reports(s, d))


@query(_COUNTED + "SELECT id, tag_id, agree + disagree + \"pass\" AS seen, round(CASE WHEN agree + disagree + \"pass\" > 0 THEN agree / (agree + disagree + \"pass\") END, 6) + 0.0 AS agree_rate FROM w WHERE status = 'approved' AND tag_id = 'T1'")
def tag_ranking(s: SparkSession, d: str) -> DataFrame:
    seen = F.col("agree") + F.col("disagree") + F.col("pass")
    at = _counted(s, d).where("status = 'approved' and tag_id = 'T1'").select("id", "tag_id", seen.alias("seen"), F.try_divide("agree", seen).alias("agree_rate"))
    return at.select("id", "tag_id", "seen", r6("agree_rate")).orderBy(F.desc("seen"), "id")


@query(with_views("opinions") + "SELECT id, created_at FROM opinions ORDER BY created_at DESC, id LIMIT 5")
def newest_opinions(s: SparkSession, d: str) -> DataFrame:
    return A.opinions(s, d).select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(5)


_CANDIDATES = ", cand AS (SELECT s.session_id, o.id, o.tag_id FROM (SELECT DISTINCT session_id FROM impressions) s JOIN opinions o ON o.status = 'approved' AND o.author_session IS DISTINCT FROM s.session_id WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.session_id = s.session_id AND f.opinion_id = o.id)) "


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return moderation.candidates(A.impressions(s, d).select("session_id").distinct(), A.opinions(s, d), _first(s, d))


@query(with_views("planted", "first", "opinions", "impressions")[:-1] + _CANDIDATES + "SELECT * FROM cand")
def candidate_set(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d)


def _issued(s: SparkSession, d: str) -> DataFrame:
    at = A.impressions(s, d).where("type = 'shown'").join(A.opinions(s, d).select(F.col("id").alias("opinion_id"), "tag_id"), "opinion_id")
    return at.groupBy("session_id", "tag_id").agg(F.count("*").alias("n"))


_ISSUED = "issued AS (SELECT session_id, tag_id, count(*) AS n FROM impressions JOIN opinions ON id = opinion_id WHERE type = 'shown' GROUP BY 1, 2)"


@query(with_views("opinions", "impressions")[:-1] + f", {_ISSUED} SELECT * FROM issued")
def issued_by_tag(s: SparkSession, d: str) -> DataFrame:
    return _issued(s, d)


def _probabilities(s: SparkSession, d: str) -> DataFrame:
    counts = ballots.opinion_counts(_first(s, d)).withColumnRenamed("opinion_id", "id")
    return routing.distribution(_candidates(s, d).join(counts, "id"), _issued(s, d))


_ROUTING = (
    with_views("planted", "first", "opinions", "impressions")[:-1] + _CANDIDATES + f", {_ISSUED}, c AS (SELECT opinion_id AS id, {ONE_COUNT} FROM first GROUP BY 1), "
    "a AS (SELECT session_id, id, tag_id, coalesce(n, 0) AS k, agree + disagree AS n2, (agree + 1) / (agree + disagree + 2) AS p, 1 / sqrt(1 + agree + disagree + \"pass\" + unrelated) AS u FROM cand JOIN c USING (id) LEFT JOIN issued USING (session_id, tag_id)), "
    "b AS (SELECT *, 4 * p * (1 - p) * n2 / (n2 + 8) AS dd, 1 / power(1 + k, 2) AS seldom FROM a), "
    "g AS (SELECT session_id, tag_id, count(*) AS m, sum(dd) AS sd, sum(u) AS su, any_value(seldom) AS seldom FROM b GROUP BY 1, 2), "
    "t AS (SELECT session_id, count(*) AS tags, sum(seldom) AS ss FROM g GROUP BY 1), "
    "pr AS (SELECT b.session_id, b.id, b.tag_id, (0.2 / tags + 0.8 * g.seldom / ss) * (0.3 / m + 0.4 * (CASE WHEN sd = 0 THEN 1 / m ELSE dd / sd END) + 0.3 * u / su) AS probability FROM b JOIN g USING (session_id, tag_id) JOIN t ON t.session_id = b.session_id) "
)


@query(_ROUTING + "SELECT session_id, id, tag_id, round(probability, 6) + 0.0 AS probability FROM pr")
def routing_distribution(s: SparkSession, d: str) -> DataFrame:
    return _probabilities(s, d).select("session_id", "id", "tag_id", r6("probability"))


@query(_ROUTING + ", q AS (SELECT *, (CAST(session_id AS INTEGER) % 97 + 0.5) / 97 AS r, sum(probability) OVER (PARTITION BY session_id ORDER BY tag_id, id) AS upto, row_number() OVER (PARTITION BY session_id ORDER BY tag_id, id) AS ord FROM pr) SELECT session_id, coalesce(arg_min(id, ord) FILTER (WHERE r < upto), arg_max(id, ord)) AS id FROM q GROUP BY 1")
def routing_draw(s: SparkSession, d: str) -> DataFrame:
    counts = ballots.opinion_counts(_first(s, d)).withColumnRenamed("opinion_id", "id")
    who = A.impressions(s, d).select("session_id").distinct().withColumn("r", (F.col("session_id").cast("int") % 97 + 0.5) / 97)
    return routing.draw_located(who, A.opinions(s, d).where("status = 'approved'").join(counts, "id"), _first(s, d), _issued(s, d))


# Scalars

_FNV = "list_reduce(list_prepend(CAST({basis} AS UBIGINT), list_transform(range(1, length(session_id) + 1), lambda i: CAST(ascii(substr(session_id, i, 1)) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query(
    with_views()[:-1] + ", h AS (SELECT session_id, " + _FNV.format(basis=2166136261 ^ 0x6A09E667) + " AS v FROM (SELECT DISTINCT session_id FROM lines)), "
    "i AS (SELECT session_id, ((xor(v, v >> 16)) * 2146121005) % 4294967296 AS v FROM h), j AS (SELECT session_id, CAST((CAST(xor(v, v >> 15) AS HUGEINT) * 2221713035) % 4294967296 AS UBIGINT) AS v FROM i) "
    "SELECT session_id, CAST(xor(v, v >> 16) AS BIGINT) AS hash FROM j"
)
def sample_order(s: SparkSession, d: str) -> DataFrame:
    """The hash that orders samples of sessions."""
    return A.ballots_raw(s, d).select("session_id").distinct().select("session_id", S.text_hash("session_id", 0x6A09E667).alias("hash"))


_UNITS = "list_concat([], flatten(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN unicode(substr(t, i, 1)) < 65536 THEN [CAST(unicode(substr(t, i, 1)) AS UBIGINT)] ELSE [CAST(55296 + (unicode(substr(t, i, 1)) - 65536) // 1024 AS UBIGINT), CAST(56320 + (unicode(substr(t, i, 1)) - 65536) % 1024 AS UBIGINT)] END)))"


@query(
    "WITH d AS (SELECT doc_id, coalesce(source, '') || ['😀', 'é', '𝒳', 'ß', '漢𝄞'][CAST(doc_id % 5 AS INTEGER) + 1] || coalesce(text[:40], '') || CAST(doc_id AS VARCHAR) AS t FROM documents), "
    f"h AS (SELECT doc_id, list_reduce(list_prepend(CAST({2166136261 ^ 0xBB67AE85} AS UBIGINT), {_UNITS}), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS v FROM d), "
    "i AS (SELECT doc_id, ((xor(v, v >> 16)) * 2146121005) % 4294967296 AS v FROM h), j AS (SELECT doc_id, CAST((CAST(xor(v, v >> 15) AS HUGEINT) * 2221713035) % 4294967296 AS UBIGINT) AS v FROM i) "
    "SELECT doc_id, CAST(xor(v, v >> 16) AS BIGINT) AS hash FROM j"
)
def utf16_hash(s: SparkSession, d: str) -> DataFrame:
    """The hash over UTF-16 units of names with characters of one and of two units."""
    sign = F.element_at(F.array(*(F.lit(c) for c in ("😀", "é", "𝒳", "ß", "漢𝄞"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    name = F.concat(F.coalesce("source", F.lit("")), sign, F.coalesce(F.substring("text", 1, 40), F.lit("")), F.col("doc_id").cast("string"))
    return A.table(s, d, "documents").select("doc_id", S.text_hash(name, 0xBB67AE85).alias("hash"))


@query(with_views("opinions") + "SELECT id, CASE WHEN created_at <> 0 THEN strftime(epoch_ms(created_at), '%Y-%m-%d') END AS utc_day, strftime(epoch_ms(created_at) + INTERVAL 9 HOURS, '%Y-%m-%d') AS local_day, sha256(id || ':' || tag_id) AS digest, strlen(source_ids) AS bytes FROM opinions")
def scalar_functions(s: SparkSession, d: str) -> DataFrame:
    return A.opinions(s, d).select("id", S.iso_day("created_at").alias("utc_day"), S.local_day("created_at").alias("local_day"), F.sha2(F.concat_ws(":", "id", "tag_id"), 256).alias("digest"), F.octet_length("source_ids").cast("long").alias("bytes"))


# Matrix, axes, projection, groups


_PAIRS = ", mv AS (SELECT v.session_id, v.opinion_id, v.value, k.mean FROM valid v SEMI JOIN eligible USING (session_id) JOIN kept k USING (opinion_id)), sc AS (SELECT a.opinion_id AS j, b.opinion_id AS k, sum(CAST(a.value * b.value AS DOUBLE)) - any_value(b.mean) * sum(a.value) - any_value(a.mean) * sum(b.value) + count(*) * any_value(a.mean) * any_value(b.mean) AS c FROM mv a JOIN mv b ON a.session_id = b.session_id AND a.opinion_id <= b.opinion_id GROUP BY 1, 2) "


@query(MODEL[:-1] + _PAIRS + "SELECT j, k, round(c, 6) + 0.0 AS c FROM sc")
def scatter_matrix(s: SparkSession, d: str) -> DataFrame:
    votes = _eligible_votes(s, d)
    return matrix.scatter(votes, ballots.retained(votes)).select("j", "k", r6("c"))


def _model(s: SparkSession, d: str) -> tuple[DataFrame, matrix.Model]:
    votes = files.Tables(s, "model").cut(_eligible_votes(s, d))
    rows = ballots.retained(votes).orderBy("opinion_id").collect()
    ids, means = [r["opinion_id"] for r in rows], [r["mean"] for r in rows]
    return votes, matrix.principal(matrix.spread(votes, ballots.retained(votes), ids), ids, means)


_SIDES = ", full_sc AS (SELECT j, k, c FROM sc UNION ALL SELECT k, j, c FROM sc WHERE j <> k), ix AS (SELECT opinion_id, row_number() OVER (ORDER BY opinion_id) AS i FROM kept), m AS (SELECT a.i AS j, list(c ORDER BY b.i) AS row FROM full_sc JOIN ix a ON a.opinion_id = j JOIN ix b ON b.opinion_id = k GROUP BY 1), mm AS (SELECT list(row ORDER BY j) AS c FROM m), "


def _power(axis: int, deflate: bool) -> str:
    """A recursive view of power iteration over lists: the matrix travels with the vector."""
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
    seed = f"list_transform(range(1, len(c) + 1), lambda i: sin(i * {axis + 1} * 1.731) + 0.2)"
    if deflate:
        inner = f"list_transform(list_zip(v, p), lambda z: z[1] - {dot('v', 'p')} * z[2])"
        step = f"SELECT n, c, p, list_transform(list_zip(o, p), lambda z: z[1] - {dot('o', 'p')} * z[2]) AS o FROM (SELECT n, c, p, list_transform(c, lambda r: {dot('r', 'q')}) AS o FROM (SELECT n, c, p, {inner} AS q FROM pow{axis} WHERE n < 100))"
        return f"pow{axis}(n, c, p, v) AS (SELECT 0, c, p, {unit('s')} FROM (SELECT c, v AS p, {seed} AS s FROM pc0) UNION ALL SELECT n + 1, c, p, {unit('o')} FROM ({step})), pc{axis} AS (SELECT c, p, v FROM pow{axis} WHERE n = 100)"
    step = f"SELECT n, c, list_transform(c, lambda r: {dot('r', 'v')}) AS o FROM pow{axis} WHERE n < 100"
    return f"pow{axis}(n, c, v) AS (SELECT 0, c, {unit('s')} FROM (SELECT c, {seed} AS s FROM mm) UNION ALL SELECT n + 1, c, {unit('o')} FROM ({step})), pc{axis} AS (SELECT c, v FROM pow{axis} WHERE n = 100)"


_AXES = (MODEL[:-1] + _PAIRS + _SIDES + _power(0, False) + ", " + _power(1, True)).replace("WITH ", "WITH RECURSIVE ", 1)
_FIX = "list_transform({v}, lambda x: x * (CASE WHEN {v}[list_position(list_transform({v}, lambda y: abs(y)), list_max(list_transform({v}, lambda y: abs(y))))] < 0 THEN -1 ELSE 1 END))"


@query(_AXES + f", ax AS (SELECT {_FIX.format(v='p')} AS a, {_FIX.format(v='v')} AS b FROM pc1) SELECT opinion_id, round(a[i], 4) + 0.0 AS pc1 FROM ix, ax")
def pca_components(s: SparkSession, d: str) -> DataFrame:
    """The first axis. The second is nearly degenerate on these tables, so it is compared by the
    variance both explain."""
    _, model = _model(s, d)
    rows = [(o, float(a)) for o, a in zip(model.opinion_ids, model.components[0], strict=True)]
    return s.createDataFrame(rows, "opinion_id string, pc1 double").select("opinion_id", (F.round("pc1", 4) + 0.0).alias("pc1"))


@query(_AXES + " SELECT round((list_dot_product(p, list_transform(c, lambda r: list_dot_product(r, p))) + list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v)))) / (SELECT sum(c) FROM sc WHERE j = k), 4) AS explained FROM pc1")
def explained_variance(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(round(_model(s, d)[1].explained, 4),)], "explained double")


#: A fixed model, so that projection has direct SQL: mean .1, axes by the brand's number.
_FIXED = "fx AS (SELECT opinion_id, 0.1 AS mean, sin(b) AS pc1, cos(b) AS pc2 FROM (SELECT DISTINCT opinion_id, b FROM lines))"
_PROJECT = f", {_FIXED}, pr AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE value <> 0) AS s, sum((value - mean) * pc1) AS x, sum((value - mean) * pc2) AS y FROM valid JOIN fx USING (opinion_id) GROUP BY 1), pt AS (SELECT session_id, x * sqrt((SELECT count(*) FROM fx) / n) AS x, y * sqrt((SELECT count(*) FROM fx) / n) AS y FROM pr WHERE s >= 6) "


def _fixed_model(s: SparkSession, d: str) -> matrix.Model:
    ids = sorted(r["id"] for r in A.opinions(s, d).select("id").collect())
    import math

    n = [int(i[1:]) for i in ids]
    return matrix.Model(ids, [0.1] * len(ids), [[math.sin(b) for b in n], [math.cos(b) for b in n]], 6, [(1.0, 0.0, 0), (-1.0, 0.0, 1), (0.0, 1.0, 2)])


@query(with_views("planted", "valid")[:-1] + _PROJECT + "SELECT session_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, CASE WHEN (x - 1) ** 2 + y ** 2 <= least((x + 1) ** 2 + y ** 2, x ** 2 + (y - 1) ** 2) THEN 0 WHEN (x + 1) ** 2 + y ** 2 <= x ** 2 + (y - 1) ** 2 THEN 1 ELSE 2 END AS \"group\" FROM pt")
def participant_projection(s: SparkSession, d: str) -> DataFrame:
    return matrix.project(_last(s, d), _fixed_model(s, d)).select("session_id", r6("x"), r6("y"), "group")


_POINTS = f", ax AS (SELECT {_FIX.format(v='p')} AS a, {_FIX.format(v='v')} AS b FROM pc1), pt AS MATERIALIZED (SELECT session_id AS id, sum((value - mean) * a[i]) * sqrt((SELECT count(*) FROM kept) / count(*)) AS x, sum((value - mean) * b[i]) * sqrt((SELECT count(*) FROM kept) / count(*)) AS y FROM valid SEMI JOIN eligible USING (session_id) JOIN kept USING (opinion_id) JOIN ix USING (opinion_id), ax GROUP BY 1) "


@query(_AXES + _POINTS + "SELECT id AS session_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM pt")
def session_points(s: SparkSession, d: str) -> DataFrame:
    votes, model = _model(s, d)
    return matrix.project(votes, model).select("session_id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(MODEL[:-1] + ", o AS (SELECT session_id, list(opinion_id ORDER BY opinion_id) AS o FROM valid SEMI JOIN eligible USING (session_id) SEMI JOIN kept USING (opinion_id) WHERE value <> 0 GROUP BY 1) SELECT len((SELECT list(o) FROM o)) = (SELECT count(*) FROM o JOIN (SELECT o AS top FROM o ORDER BY len(o) DESC, o LIMIT 1) ON len(list_intersect(o, top)) >= 3) AS connected")
def overlap_connected(s: SparkSession, d: str) -> DataFrame:
    """Here one session shares three opinions with each other one, which the SQL shows."""
    votes = _last(s, d)
    sessions = ballots.eligible(votes)
    mine = ballots.of_sessions(votes, sessions)
    return s.createDataFrame([(matrix.connected(mine, sessions, ballots.retained(mine)),)], "connected boolean")


@query(
    "WITH RECURSIVE v AS (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS s, l_suppkey AS o FROM lineitem), e AS MATERIALIZED (SELECT a.s AS x, b.s AS y FROM v a JOIN v b ON a.o = b.o GROUP BY 1, 2 HAVING count(*) >= 3), "
    "r(i, node, label, changed) AS (SELECT 0, s, s, true FROM (SELECT DISTINCT s FROM v) UNION ALL SELECT i + 1, node, least(label, l), coalesce(l < label, false) FROM (SELECT r.i, r.node, r.label, m.l FROM r LEFT JOIN (SELECT e.y AS node, min(label) AS l FROM r JOIN e ON e.x = r.node GROUP BY 1) m USING (node)) WHERE (SELECT bool_or(changed) FROM r)) "
    "SELECT node AS session_id, label AS component FROM r WHERE i = (SELECT max(i) FROM r)"
)
def overlap_components(s: SparkSession, d: str) -> DataFrame:
    """Orders as sessions and their suppliers as opinions: a graph of many components."""
    votes = A.table(s, d, "lineitem").select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("session_id"), F.col("l_suppkey").cast("string").alias("opinion_id"), F.lit(1).alias("value"))
    return matrix.overlap_components(votes, votes.select("session_id").distinct(), votes.select("opinion_id").distinct())


def _hash_sql(text: str, salt: int) -> str:
    """The hash of an ASCII text, as one expression."""
    v = f"list_reduce(list_prepend(CAST({2166136261 ^ salt} AS UBIGINT), list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
    v = f"list_transform(list_transform([{v}], lambda v: (xor(v, v >> 16) * 2146121005) % 4294967296), lambda v: CAST((CAST(xor(v, v >> 15) AS HUGEINT) * 2221713035) % 4294967296 AS UBIGINT))"
    return f"list_transform({v}, lambda v: xor(v, v >> 16))[1]"


def _near(cs: str) -> str:
    far = f"list_transform({cs}, lambda c: (x - c.x) ** 2 + (y - c.y) ** 2)"
    return f"(list_position({far}, list_min({far})) - 1)"


#: k-means over all starts as recursion over centres, and each result's sampled silhouette.
_KMEANS = (
    f", ph AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY h1, id) - 1 AS r FROM (SELECT *, {_hash_sql('id', 0x6A09E667)} AS h1, {_hash_sql('id', 0xBB67AE85)} AS h2 FROM pt)), pn AS (SELECT count(*) AS n FROM ph), "
    "fc(s, k, cs) AS (SELECT CAST(t.s AS BIGINT), 1, [struct_pack(x := x, y := y)] FROM range(0, 4) t(s), pn JOIN ph ON r = t.s * n // 4 UNION ALL SELECT s, k + 1, list_append(any_value(cs), arg_min(struct_pack(x := x, y := y), (-d, id))) FROM (SELECT fc.s, fc.k, fc.cs, id, x, y, list_min(list_transform(cs, lambda c: (x - c.x) ** 2 + (y - c.y) ** 2)) AS d FROM fc, ph WHERE fc.k < 4) GROUP BY s, k), "
    "ll(k, s, it, cs, before, stop, dead, sizes) AS (SELECT k, s, 0, cs, CAST(NULL AS STRUCT(x DOUBLE, y DOUBLE)[]), false, false, CAST(NULL AS BIGINT[]) FROM fc WHERE k > 1 UNION ALL "
    "SELECT k, s, it + 1, list(struct_pack(x := mx, y := my) ORDER BY g), any_value(cs), sum(moved) = 0 OR min(n) < 3 OR count(*) < k OR it + 1 = 60, min(n) < 3 OR count(*) < k, list(n ORDER BY g) FROM "
    f"(SELECT k, s, it, g, any_value(cs) AS cs, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(moved) AS moved FROM (SELECT k, s, it, cs, x, y, {_near('cs')} AS g, CASE WHEN before IS NULL THEN 1 WHEN {_near('cs')} <> {_near('before')} THEN 1 ELSE 0 END AS moved FROM ll, ph WHERE NOT stop) GROUP BY 1, 2, 3, 4) GROUP BY k, s, it), "
    "le AS MATERIALIZED (SELECT k, s, before, dead, sizes FROM ll WHERE stop), "
    f"lb AS MATERIALIZED (SELECT k, s, id, x, y, h1, h2, {_near('before')} AS g FROM le, ph WHERE NOT dead), "
    "tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, s, g ORDER BY h1, id) AS j FROM lb) WHERE j <= 256), rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, s, g ORDER BY h2, id) AS j FROM lb) WHERE j <= 128), "
    "dm AS (SELECT t.k, t.s, t.id, t.g, f.g AS o, avg(sqrt((t.x - f.x) ** 2 + (t.y - f.y) ** 2)) AS m FROM tg t JOIN rf f ON t.k = f.k AND t.s = f.s AND t.id <> f.id GROUP BY 1, 2, 3, 4, 5), "
    "sa AS (SELECT k, s, id, g, max(m) FILTER (WHERE g = o) AS a, min(m) FILTER (WHERE g <> o) AS b FROM dm GROUP BY 1, 2, 3, 4), sg AS (SELECT k, s, g, sum(coalesce((b - a) / greatest(a, b, 1e-9), 0)) / count(*) AS v FROM sa GROUP BY 1, 2, 3), "
    "cd AS MATERIALIZED (SELECT le.k, le.s, CASE WHEN NOT dead THEN (SELECT sum(v * le.sizes[sg.g + 1]) FROM sg WHERE sg.k = le.k AND sg.s = le.s) / (SELECT n FROM pn) END AS silhouette, CASE WHEN NOT dead THEN sizes END AS sizes FROM le) "
)
_CONNECTED = "o AS (SELECT session_id, list(opinion_id ORDER BY opinion_id) AS o FROM valid SEMI JOIN eligible USING (session_id) SEMI JOIN kept USING (opinion_id) WHERE value <> 0 GROUP BY 1), cn AS (SELECT len((SELECT list(o) FROM o)) = (SELECT count(*) FROM o JOIN (SELECT o AS top FROM o ORDER BY len(o) DESC, o LIMIT 1) ON len(list_intersect(o, top)) >= 3) AS connected)"
_EXPLAINED = "(SELECT (list_dot_product(p, list_transform(c, lambda r: list_dot_product(r, p))) + list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v)))) / (SELECT sum(c) FROM sc WHERE j = k) FROM pc1)"


@query(
    _AXES + _POINTS[:-1] + _KMEANS[:-1] + f", {_CONNECTED}, tp AS (SELECT * FROM cd WHERE silhouette IS NOT NULL ORDER BY silhouette DESC, k, s LIMIT 1), "
    "st AS (SELECT (SELECT count(*) FROM eligible) AS eligible, CASE WHEN (SELECT count(*) FROM eligible) < 80 OR (SELECT count(*) FROM kept) < 6 OR NOT (SELECT connected FROM cn) THEN 'collecting' WHEN (SELECT sum(c) FROM sc WHERE j = k) < 1e-8 THEN 'uniform' WHEN coalesce((SELECT silhouette FROM tp), -1) < 0.45 THEN 'unclear' ELSE 'ready' END AS status) "
    f"SELECT status, eligible, CASE WHEN status = 'ready' THEN (SELECT k FROM tp) ELSE 0 END AS groups, CASE WHEN status = 'ready' THEN round({_EXPLAINED}, 4) END AS explained, CASE WHEN status = 'ready' THEN round((SELECT silhouette FROM tp), 4) END AS silhouette, status = 'ready' AND (SELECT list_max(sizes) > 128 FROM tp) AS approximate FROM st"
)
def analysis_status(s: SparkSession, d: str) -> DataFrame:
    """Status, groups and silhouette of the whole analysis."""
    r = analysis.analyze(A.ballots_planted(s, d))
    four = lambda v: None if v is None else round(v, 4)
    r.release()
    return s.createDataFrame([(r.status, r.eligible, len(r.groups), four(r.explained), four(r.silhouette), r.approximate)], "status string, eligible long, groups int, explained double, silhouette double, approximate boolean")


@query(_AXES + _POINTS[:-1] + _KMEANS + "SELECT k, CAST(s AS INTEGER) AS start, round(silhouette, 4) AS silhouette, array_to_string(sizes, ',') AS sizes FROM cd")
def kmeans_candidates(s: SparkSession, d: str) -> DataFrame:
    """Each number of groups and start: its groups' sizes and silhouette, null where a group got too small."""
    r = analysis.analyze(A.ballots_planted(s, d))
    r.release()
    rows = [(k, i, None if q is None else round(q, 4), None if sizes is None else ",".join(map(str, sizes))) for k, i, q, sizes in r.diagnostics["candidates"]]
    return s.createDataFrame(rows, "k int, start int, silhouette double, sizes string")


_GROUPS = ", gr AS (SELECT DISTINCT session_id, CAST(session_id AS INTEGER) % 2 AS \"group\" FROM eligible), gc AS (SELECT \"group\", opinion_id, count(*) FILTER (WHERE value = -1) AS agree, count(*) AS seen FROM valid JOIN gr USING (session_id) GROUP BY 1, 2), wl AS (SELECT *, agree / seen AS rate, greatest(0, (agree / seen + 1.96 ** 2 / (2 * seen) - 1.96 * sqrt((agree / seen) * (1 - agree / seen) / seen + 1.96 ** 2 / (4 * seen ** 2))) / (1 + 1.96 ** 2 / seen)) AS lower_bound FROM gc) "


def _group_counts(s: SparkSession, d: str) -> DataFrame:
    votes = _last(s, d)
    groups = ballots.eligible(votes).select("session_id", (F.col("session_id").cast("int") % 2).alias("group"))
    return bridges.group_counts(votes, groups)


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + "SELECT \"group\", opinion_id, agree, seen FROM gc")
def group_opinion_counts(s: SparkSession, d: str) -> DataFrame:
    return _group_counts(s, d)


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + "SELECT \"group\", opinion_id, round(rate, 6) + 0.0 AS rate, round(lower_bound, 6) + 0.0 AS lower_bound FROM wl")
def wilson_bounds(s: SparkSession, d: str) -> DataFrame:
    return _group_counts(s, d).select("group", "opinion_id", F.round(S.rate("agree", "seen"), 6).alias("rate"), F.round(S.wilson_lower("agree", "seen"), 6).alias("lower_bound"))


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + "SELECT opinion_id, round(product((agree + 1) / (seen + 2)), 6) AS score FROM gc GROUP BY 1")
def consensus_scores(s: SparkSession, d: str) -> DataFrame:
    at = _group_counts(s, d).groupBy("opinion_id").agg(F.array_sort(F.collect_list(F.struct("group", "agree", "seen"))).alias("c"))
    return at.select("opinion_id", F.round(S.consensus("c"), 6).alias("score"))


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + "SELECT opinion_id, round(product((agree + 1) / (seen + 2)), 6) AS score FROM wl GROUP BY 1 HAVING count(*) = 2 AND bool_and(seen >= 10 AND rate >= 0.6 AND lower_bound > 0.5)")
def bridges_ranked(s: SparkSession, d: str) -> DataFrame:
    return bridges.ranked(bridges.bridges(_group_counts(s, d), 2)).select("opinion_id", F.round("score", 6).alias("score"))


# Map geometry


def _hull_sql(points: str, name: str) -> str:
    """Hulls of points(label, x, y) by wrapping: an edge has no point to its right; of edges from a corner the
    longest; corners are followed from the lowest x, then y."""
    u, e, n, r = (f"{name}_{c}" for c in "uenr")
    return (
        f"{u} AS MATERIALIZED (SELECT DISTINCT label, x, y FROM {points}), {e} AS (SELECT p.label, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM {u} p JOIN {u} q ON p.label = q.label AND (p.x <> q.x OR p.y <> q.y) JOIN {u} t ON t.label = p.label GROUP BY 1, 2, 3, 4, 5 HAVING min((q.x - p.x) * (t.y - p.y) - (q.y - p.y) * (t.x - p.x)) >= 0), "
        f"{n} AS MATERIALIZED (SELECT label, px, py, arg_max(qx, (qx - px) ** 2 + (qy - py) ** 2) AS qx, arg_max(qy, (qx - px) ** 2 + (qy - py) ** 2) AS qy FROM {e} GROUP BY 1, 2, 3), "
        f"{r}(label, ord, x, y, x0, y0) AS (SELECT label, 0, min(x), arg_min(y, (x, y)), min(x), arg_min(y, (x, y)) FROM {u} GROUP BY 1 UNION ALL SELECT {r}.label, ord + 1, qx, qy, x0, y0 FROM {r} JOIN {n} ON {n}.label = {r}.label AND px = {r}.x AND py = {r}.y WHERE qx <> x0 OR qy <> y0) "
    )


_HULLS = with_views("points").replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + ", " + _hull_sql("points", "h")


@query(_HULLS + "SELECT label, ord, x, y FROM h_r")
def convex_hulls(s: SparkSession, d: str) -> DataFrame:
    return geometry.hulls(A.points(s, d), "label")


@query(_HULLS[:-1] + ", ci AS (SELECT label, x + 0.05 * cos(k * pi() / 12) AS x, y + 0.05 * sin(k * pi() / 12) AS y FROM h_r, range(0, 24) t(k)), " + _hull_sql("ci", "g") + "SELECT label, ord, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM g_r")
def padded_hulls(s: SparkSession, d: str) -> DataFrame:
    return geometry.hulls(A.points(s, d), "label", 0.05).select("label", "ord", r6("x"), r6("y"))


@query(with_views("points")[:-1] + ", e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points), p AS (SELECT *, 0.15 * greatest(hx - lx, 0.1) AS ax, 0.15 * greatest(hy - ly, 0.1) AS ay FROM points, e) SELECT id, round(35 + greatest(0, least(1, (x - lx + ax) / (hx - lx + 2 * ax))) * 430, 6) AS px, round(310 - greatest(0, least(1, (y - ly + ay) / (hy - ly + 2 * ay))) * 275, 6) AS py FROM p")
def map_scaling(s: SparkSession, d: str) -> DataFrame:
    return geometry.map_scaling(A.points(s, d)).select("id", r6("px"), r6("py"))


@query(with_views("points") + "SELECT label, count(*) AS n, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy FROM points GROUP BY 1")
def region_centroids(s: SparkSession, d: str) -> DataFrame:
    return geometry.region_centroids(A.points(s, d), "label").select("label", "n", r6("cx"), r6("cy"))


@query(_HULLS[:-1] + ", ci AS (SELECT label, x + 0.05 * cos(k * pi() / 12) AS x, y + 0.05 * sin(k * pi() / 12) AS y FROM h_r, range(0, 24) t(k)), " + _hull_sql("ci", "g")[:-1] + ", ou AS (SELECT label, string_agg(printf('%.3f:%.3f', x, y), ' ' ORDER BY ord) AS outline FROM g_r GROUP BY 1) SELECT label, count(*) AS n, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, any_value(outline) AS outline FROM points JOIN ou USING (label) GROUP BY 1")
def region_outlines(s: SparkSession, d: str) -> DataFrame:
    at = geometry.regions(A.points(s, d), "label", 0.05)
    return at.select("label", "n", r6("cx"), r6("cy"), F.array_join(F.transform("outline", lambda c: F.format_string("%.3f:%.3f", c["x"], c["y"])), " ").alias("outline"))


_SIL = (
    ", tr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS rk FROM points), t AS (SELECT * FROM tr WHERE rk <= 64), f AS (SELECT * FROM tr WHERE rk <= 32), "
    "ds AS (SELECT t.id, t.label AS own, f.label AS other, avg(sqrt((t.x - f.x) ** 2 + (t.y - f.y) ** 2)) AS m FROM t JOIN f ON t.id <> f.id GROUP BY 1, 2, 3), "
    "ab AS (SELECT id, own, max(m) FILTER (WHERE own = other) AS a, min(m) FILTER (WHERE own <> other) AS b FROM ds GROUP BY 1, 2), "
    "gs AS (SELECT t.label, sum(coalesce((b - a) / greatest(a, b, 1e-9), 0)) / count(*) AS v FROM t LEFT JOIN ab ON ab.id = t.id GROUP BY 1) "
    "SELECT round(sum(v * n) / sum(n), 6) AS silhouette FROM gs JOIN (SELECT label, count(*) AS n FROM points GROUP BY 1) USING (label)"
)


@query(with_views("points")[:-1] + _SIL)
def silhouette(s: SparkSession, d: str) -> DataFrame:
    """Sampled silhouette of given labels: bounded samples of each group."""
    rows = A.points(s, d)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first = lambda most: geometry.sample_first(rows, "label", ["id"], most).toPandas()
    t, f = first(64), first(32)
    of = lambda p: [p[p["label"] == g][["id", "x", "y"]].to_numpy() for g in sorted(sizes)]
    return s.createDataFrame([(round(cluster.silhouette(np.array([sizes[g] for g in sorted(sizes)]), of(t), of(f)), 6),)], "silhouette double")


# Evaluation


def _two_labels(s: SparkSession, d: str) -> DataFrame:
    return A.points(s, d).select("id", "label", F.when(F.col("x") > 0, 1).otherwise(0).alias("side"))


_TWO = ", tl AS (SELECT id, label, CASE WHEN x > 0 THEN 1 ELSE 0 END AS side FROM points) "


@query(with_views("points")[:-1] + _TWO + ", c AS (SELECT label, side, count(*) AS n FROM tl GROUP BY 1, 2), q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS r, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY side)) AS k, (SELECT sum(n) FROM c) AS t) SELECT round((b - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) + 0.0 AS ari FROM q")
def ari(s: SparkSession, d: str) -> DataFrame:
    return evaluate.ari(_two_labels(s, d), "label", "side").select(r6("ari"))


@query(with_views("points")[:-1] + _TWO + ", c AS (SELECT label, side, count(*) AS overlap FROM tl GROUP BY 1, 2), t AS (SELECT label, count(*) AS e FROM tl GROUP BY 1), f AS (SELECT side, count(*) AS z FROM tl GROUP BY 1), j AS (SELECT *, overlap / (e + z - overlap) AS jaccard, row_number() OVER (PARTITION BY label ORDER BY overlap / (e + z - overlap) DESC, side) AS rn FROM c JOIN t USING (label) JOIN f USING (side)) SELECT label, side, overlap, round(overlap / z, 6) AS precision, round(overlap / e, 6) AS recall, round(jaccard, 6) AS jaccard FROM j WHERE rn = 1")
def group_recovery(s: SparkSession, d: str) -> DataFrame:
    return evaluate.group_recovery(_two_labels(s, d), "label", "side").select("label", "side", "overlap", r6("precision"), r6("recall"), r6("jaccard"))


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + ", found AS (SELECT opinion_id FROM wl GROUP BY 1 HAVING count(*) = 2 AND bool_and(seen >= 10 AND rate >= 0.6 AND lower_bound > 0.5)), truth AS (SELECT DISTINCT opinion_id FROM lines WHERE b % 5 = 2) SELECT hit, found, \"true\", round(hit / found, 6) AS precision, round(hit / \"true\", 6) AS recall FROM (SELECT count(*) AS hit FROM found SEMI JOIN truth USING (opinion_id)), (SELECT count(*) AS found FROM found), (SELECT count(*) AS \"true\" FROM truth)")
def bridge_quality(s: SparkSession, d: str) -> DataFrame:
    found = bridges.bridges(_group_counts(s, d), 2).select("opinion_id")
    truth = A.opinions(s, d).where(F.substring("id", 2, 2).cast("int") % 5 == 2).select(F.col("id").alias("opinion_id"))
    return evaluate.bridge_quality(found, truth).select("hit", "found", "true", r6("precision"), r6("recall"))


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + "SELECT t AS threshold, count(*) FILTER (WHERE agree / seen >= t) AS n FROM gc, (VALUES (0.2), (0.3), (0.35), (0.4), (0.45), (0.5), (0.55), (0.6)) v(t) GROUP BY 1")
def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_sweep(_group_counts(s, d).withColumn("rate", S.rate("agree", "seen")), "rate", [0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6])


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + ", e AS (SELECT v AS min_votes, r AS min_rate, opinion_id, bool_and(seen >= v AND agree / seen >= r) AND count(*) = 2 AS ok FROM gc, (VALUES (3), (10), (20), (30)) a(v), (VALUES (0.6), (0.65), (0.7)) b(r) GROUP BY 1, 2, 3) SELECT CAST(min_votes AS INTEGER) AS min_votes, CAST(min_rate AS DOUBLE) AS min_rate, count(*) FILTER (WHERE ok) AS accepted FROM e GROUP BY 1, 2")
def bridge_sweep(s: SparkSession, d: str) -> DataFrame:
    return evaluate.bridge_sweep(_group_counts(s, d), 2, [3, 10, 20, 30], [0.6, 0.65, 0.7])


@query(
    with_views("planted", "valid", "eligible")[:-1] + _GROUPS + ", t AS (SELECT DISTINCT seen AS n, CAST(ceil(seen * 60 / 100) AS INTEGER) AS need FROM gc), "
    "o AS (SELECT n, need, list_sum(list_transform(range(need, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5)))) AS one FROM t) SELECT n, need, round(one, 6) AS one, round(one * one, 6) AS two, round(40 * one * one, 6) AS expected FROM o"
)
def binomial_tail(s: SparkSession, d: str) -> DataFrame:
    """How often groups of the sizes that occur would pass by chance."""
    sizes = _group_counts(s, d).select(F.col("seen").alias("n")).distinct()
    return evaluate.binomial_tail(sizes).select("n", "need", r6("one"), r6("two"), r6("expected"))


@query(FIRST[:-1] + ", n AS (SELECT opinion_id, count(*) AS n FROM first GROUP BY 1) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(avg(n) FILTER (WHERE opinion_id IN (SELECT opinion_id FROM lines WHERE b % 5 = 2)), 6) AS common_mean FROM n")
def exposure(s: SparkSession, d: str) -> DataFrame:
    """Least, most and mean answers of an opinion, and the mean of the common ones."""
    counts = _first(s, d).groupBy("opinion_id").agg(F.count("*").alias("n"))
    common = A.opinions(s, d).where(F.substring("id", 2, 2).cast("int") % 5 == 2).select(F.col("id").alias("opinion_id"))
    every, some = evaluate.exposure(counts).select("least", "most", r6("mean")), evaluate.exposure_of(counts, common).select(F.round("mean", 6).alias("common_mean"))
    return every.crossJoin(some)


@query(with_views("planted", "first", "opinions", "reports")[:-1] + ", r AS (SELECT opinion_id AS id, count(*) AS n FROM reports GROUP BY 1) SELECT status, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, count(n) AS known FROM opinions LEFT JOIN r USING (id) GROUP BY 1")
def reports_by_status(s: SparkSession, d: str) -> DataFrame:
    """Reports of an opinion by its status; opinions without any are unknown, not 0."""
    n = A.reports(s, d).groupBy(F.col("opinion_id").alias("id")).agg(F.count("*").alias("n"))
    return evaluate.summary(A.opinions(s, d).join(n, "id", "left"), "status", "n").withColumn("mean", F.round("mean", 6))


@query(with_views("planted", "valid")[:-1] + ", n AS (SELECT session_id, count(*) FILTER (WHERE value <> 0) AS k, row_number() OVER (ORDER BY session_id) AS rn FROM valid GROUP BY 1) SELECT CAST(m AS INTEGER) AS minimum, CAST(p AS INTEGER) AS sessions, count(*) FILTER (WHERE rn <= p AND k >= m) AS eligible FROM n, (VALUES (6), (8), (12), (16)) a(m), (VALUES (40), (100), (1000)) b(p) GROUP BY 1, 2")
def eligibility_grid(s: SparkSession, d: str) -> DataFrame:
    return evaluate.eligibility_grid(_last(s, d), [6, 8, 12, 16], [40, 100, 1000])


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + "SELECT \"group\", agree, seen, round(rate, 6) AS rate, round(lower_bound, 6) AS lower_bound, seen >= 10 AND rate >= 0.6 AND lower_bound > 0.5 AS enough FROM wl WHERE opinion_id = 'O12'")
def focus_bridge(s: SparkSession, d: str) -> DataFrame:
    """One opinion's evidence in every group."""
    at = _group_counts(s, d).where("opinion_id = 'O12'")
    return at.select("group", "agree", "seen", F.round(S.rate("agree", "seen"), 6).alias("rate"), F.round(S.wilson_lower("agree", "seen"), 6).alias("lower_bound"), S.has_evidence("agree", "seen").alias("enough"))


@query(with_views("planted", "valid", "eligible")[:-1] + _GROUPS + "SELECT opinion_id, round(min(agree / seen), 6) AS least FROM gc GROUP BY 1 HAVING count(*) = 2 AND min(agree / seen) >= 0.6")
def true_bridges(s: SparkSession, d: str) -> DataFrame:
    """Opinions that three fifths of each planted side agree with."""
    at = _group_counts(s, d).withColumn("rate", S.rate("agree", "seen")).groupBy("opinion_id").agg(F.min("rate").alias("least"), F.count("*").alias("n"))
    return at.where("n = 2 and least >= 0.6").select("opinion_id", F.round("least", 6).alias("least"))


@query(with_views("opinions") + "SELECT status, count(*) AS n FROM opinions GROUP BY 1")
def status_histogram(s: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(A.opinions(s, d), "status")


@query(with_views("points")[:-1] + _TWO + ", tk AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM tl) WHERE (rn - 1) % 10 <> 0), c AS (SELECT label, side, count(*) AS n FROM tk GROUP BY 1, 2), q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS r, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY side)) AS k, (SELECT sum(n) FROM c) AS t) SELECT round((b - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) + 0.0 AS ari FROM q")
def label_agreement(s: SparkSession, d: str) -> DataFrame:
    """Agreement of two labellings after every tenth row is taken away."""
    rows = release.numbered(_two_labels(s, d), ["id"]).where(F.pmod(F.col("rn") - 1, F.lit(10)) != 0)
    return evaluate.ari(rows, "label", "side").select(r6("ari"))


@query(
    _AXES + _POINTS[:-1] + _KMEANS[:-1] + ", tp AS (SELECT * FROM cd WHERE silhouette IS NOT NULL ORDER BY silhouette DESC, k, s LIMIT 1), tl AS (SELECT CAST(id AS INTEGER) % 2 AS label, g AS side FROM lb JOIN tp USING (k, s)), c AS (SELECT label, side, count(*) AS n FROM tl GROUP BY 1, 2), q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS r, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY side)) AS k, (SELECT sum(n) FROM c) AS t) "
    "SELECT CASE WHEN (SELECT silhouette FROM tp) >= 0.45 THEN 'ready' ELSE 'unclear' END AS status, CASE WHEN (SELECT silhouette FROM tp) >= 0.45 THEN round((b - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) + 0.0 END AS ari FROM q"
)
def scenario_recovery(s: SparkSession, d: str) -> DataFrame:
    """The planted sides, analysed: status and agreement of found with true groups."""
    r = analysis.analyze(A.ballots_planted(s, d))
    if r.points is None:
        return s.createDataFrame([(r.status, None)], "status string, ari double")
    sides = r.points.select((F.col("session_id").cast("int") % 2).alias("truth"), "group")
    return evaluate.ari(sides, "truth", "group").select(F.lit(r.status).alias("status"), r6("ari"))


@query(
    _AXES + _POINTS[:-1] + _KMEANS[:-1] + ", tp AS (SELECT * FROM cd WHERE silhouette IS NOT NULL ORDER BY silhouette DESC, k, s LIMIT 1), tl AS (SELECT id, CAST(id AS INTEGER) % 2 AS label, g AS side FROM lb JOIN tp USING (k, s)), c AS (SELECT label, side, count(*) AS n FROM tl GROUP BY 1, 2), q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS r, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY side)) AS k, (SELECT sum(n) FROM c) AS t), "
    "jc AS (SELECT label, max(n / (e + z - n)) AS j FROM c JOIN (SELECT label, sum(n) AS e FROM c GROUP BY 1) USING (label) JOIN (SELECT side, sum(n) AS z FROM c GROUP BY 1) USING (side) GROUP BY 1), "
    "gb AS (SELECT side, opinion_id, count(*) FILTER (WHERE value = -1) AS agree, count(*) AS seen FROM valid JOIN tl ON id = session_id GROUP BY 1, 2), wb AS (SELECT *, agree / seen AS rate, greatest(0, (agree / seen + 1.96 ** 2 / (2 * seen) - 1.96 * sqrt((agree / seen) * (1 - agree / seen) / seen + 1.96 ** 2 / (4 * seen ** 2))) / (1 + 1.96 ** 2 / seen)) AS lb FROM gb), "
    "found AS (SELECT opinion_id FROM wb GROUP BY 1 HAVING count(*) = (SELECT k FROM tp) AND bool_and(seen >= 10 AND rate >= 0.6 AND lb > 0.5)), truth AS (SELECT DISTINCT opinion_id FROM lines WHERE b % 5 = 2) "
    "SELECT round((b - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) + 0.0 AS ari, round((SELECT avg(j) FROM jc), 6) AS jaccard, (SELECT count(*) FROM found SEMI JOIN truth USING (opinion_id)) AS hit, (SELECT count(*) FROM found) AS found, (SELECT count(*) FROM truth) AS \"true\" FROM q"
)
def evaluation(s: SparkSession, d: str) -> DataFrame:
    """The whole analysis of the planted ballots against what was planted: groups and bridges."""
    r, tables = analysis.analyze(A.ballots_planted(s, d)), files.Tables(s, "evaluation")
    labels = tables.cut(r.points.select("session_id", (F.col("session_id").cast("int") % 2).alias("truth"), "group"))
    found = tables.cut(r.bridges.select("opinion_id"))
    r.release()
    truth = A.opinions(s, d).where(F.substring("id", 2, 2).cast("int") % 5 == 2).select(F.col("id").alias("opinion_id"))
    return evaluate.evaluate(labels, found, truth).select(r6("ari"), F.round("jaccard", 6).alias("jaccard"), "hit", "found", "true")


# Releases


@query(with_views("opinions") + "SELECT id, tag_id, array_to_string(CAST(source_ids::JSON AS VARCHAR[]), '|') AS sources, CASE WHEN created_at <> 0 THEN strftime(epoch_ms(created_at), '%Y-%m-%d') END AS created_date FROM opinions WHERE status = 'approved'")
def release_opinions(s: SparkSession, d: str) -> DataFrame:
    return moderation.public_opinions(A.opinions(s, d)).select("id", "tag_id", F.array_join("source_ids", "|").alias("sources"), "created_date")


@query(with_views("planted", "first", "opinions") + "SELECT session_id, opinion_id, CASE value WHEN -1 THEN 'agree' WHEN 1 THEN 'disagree' WHEN 0 THEN 'pass' ELSE 'unrelated' END AS response, CASE WHEN value <> 2 THEN value END AS analysis_value FROM first JOIN opinions ON id = opinion_id AND status = 'approved'")
def release_responses(s: SparkSession, d: str) -> DataFrame:
    return moderation.public_responses(_first(s, d), A.opinions(s, d).where("status = 'approved'"))


@query(with_views("impressions") + "SELECT session_id, opinion_id, bool_or(type = 'shown') AS displayed, bool_or(type = 'answered') AS answered, bool_or(type = 'retired') AS retired FROM impressions GROUP BY 1, 2")
def release_presentations(s: SparkSession, d: str) -> DataFrame:
    return moderation.public_presentations(A.impressions(s, d))


@query(with_views("impressions")[:-1] + ", w AS (SELECT max(event_id) // 2 AS m FROM events) SELECT session_id, opinion_id, bool_or(type = 'shown') AS displayed, bool_or(type = 'answered') AS answered, bool_or(type = 'retired') AS retired FROM impressions WHERE event_id <= (SELECT m FROM w) GROUP BY 1, 2")
def late_rows_excluded(s: SparkSession, d: str) -> DataFrame:
    events = A.table(s, d, "events")
    mark = release.freeze({"events": (events, "event_id")})["events"] // 2
    return moderation.public_presentations(A.impressions(s, d), mark)


@query(FIRST[:-1] + ", n AS (SELECT (row_number() OVER (ORDER BY session_id, opinion_id) - 1) // 500 AS page, session_id, opinion_id FROM first) SELECT page, count(*) AS n, min(session_id) AS first_session, max(session_id) AS last_session FROM n GROUP BY 1")
def release_pages(s: SparkSession, d: str) -> DataFrame:
    rows = release.page_numbers(release.numbered(_first(s, d), ["session_id", "opinion_id"]))
    return rows.groupBy("page").agg(F.count("*").alias("n"), F.min("session_id").alias("first_session"), F.max("session_id").alias("last_session"))


_RESPONSE = "CASE value WHEN -1 THEN 'agree' WHEN 1 THEN 'disagree' WHEN 0 THEN 'pass' ELSE 'unrelated' END"
_RESPONSE_LINE = f"""'{{"session_id":"' || session_id || '","opinion_id":"' || opinion_id || '","response":"' || {_RESPONSE} || '","analysis_value":' || CASE WHEN value <> 2 THEN CAST(value AS VARCHAR) ELSE 'null' END || '}}'"""


def _pages_sql(rows: str, name: str, page_bytes: int) -> str:
    """Views of greedy pages over rows(k, rn, line, included), each k by itself: where a page that begins at a
    row ends, for every row; the pages that begin where one ended; their bodies."""
    x, n, p, b = (f"{name}_{c}" for c in "xnpb")
    return (
        f"{x} AS MATERIALIZED (SELECT *, sum(z) OVER (PARTITION BY k ORDER BY rn) AS upto FROM (SELECT *, CASE WHEN included THEN strlen(line) + 1 ELSE 0 END AS z FROM {rows})), "
        f"{n} AS MATERIALIZED (SELECT s.k, s.rn, s.rn + 1 + count(y.rn) AS after FROM {x} s LEFT JOIN {x} y ON y.k = s.k AND y.rn > s.rn AND y.rn < s.rn + 500 AND y.upto - s.upto + s.z <= {page_bytes} GROUP BY 1, 2), "
        f"{p}(k, a) AS (SELECT k, min(rn) FROM {n} GROUP BY 1 UNION ALL SELECT {p}.k, {n}.after FROM {p} JOIN {n} ON {n}.k = {p}.k AND {n}.rn = a), "
        f"{b} AS MATERIALIZED (SELECT x.k, row_number() OVER (PARTITION BY x.k ORDER BY a) AS page, min(rn) AS first_rn, max(rn) AS last_rn, count(*) FILTER (WHERE included) AS rows, CAST(sum(z) AS BIGINT) AS byte_length, sha256(string_agg(line || chr(10), '' ORDER BY rn) FILTER (WHERE included)) AS sha256 "
        f"FROM {x} x ASOF JOIN {p} p ON p.k = x.k AND p.a <= x.rn GROUP BY x.k, a HAVING count(*) FILTER (WHERE included) > 0) "
    )


@query(FIRST.replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + f", li AS (SELECT 1 AS k, row_number() OVER (ORDER BY session_id, opinion_id) AS rn, {_RESPONSE_LINE} AS line, value <> 2 AS included FROM first JOIN (SELECT DISTINCT 'O' || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 2, '0') AS opinion_id FROM part) USING (opinion_id)), " + _pages_sql("li", "g", 40_000) + "SELECT page, first_rn, last_rn, rows, byte_length, sha256 FROM g_b")
def release_page_bodies(s: SparkSession, d: str) -> DataFrame:
    """Pages with their bytes and digests, by both rules."""
    rows = moderation.public_responses(_first(s, d), A.opinions(s, d))
    rows = release.numbered(rows, ["session_id", "opinion_id"]).withColumns({"line": release.lines_of(rows, ["session_id", "opinion_id", "response", "analysis_value"]), "included": F.col("response") != "unrelated"})
    return release.pages(rows, page_bytes=40_000).drop("body")


def _release_sources(s: SparkSession, d: str) -> release_build.Sources:
    at = A.opinions(s, d)
    public = at.select("id", "status", F.lit(1).alias("revision"), F.col("created_at").alias("seq"), F.from_json("source_ids", "array<string>").alias("source_ids"), "tag_id", S.iso_day("created_at").alias("created_date"))
    opinions = public.withColumn("line", release.lines_of(public, ["id", "tag_id", "source_ids", "created_date"]))
    answers = moderation.public_responses(_first(s, d), at)
    seq = F.concat("session_id", "opinion_id").alias("seq")
    responses = answers.select(seq, "opinion_id", release.lines_of(answers, ["session_id", "opinion_id", "response", "analysis_value"]).alias("line"))

    def presentations(marks: dict) -> DataFrame:
        rows = moderation.public_presentations(A.impressions(s, d), marks["events"])
        return rows.select(seq, "opinion_id", release.lines_of(rows, ["session_id", "opinion_id", "displayed", "answered", "retired"]).alias("line"))

    marks = lambda: release.freeze({"opinions": (at, "created_at"), "events": (A.table(s, d, "events"), "event_id")}) | {"responses": "99999999O99"}
    return release_build.Sources(opinions, responses, presentations, marks)


_ref = """'{"part":"' || part || '","sha256":"' || sha256 || '","row_count":' || rows || ',"byte_length":' || byte_length || '}'"""
_INDEX = (
    f"dp AS MATERIALIZED (SELECT k AS kind, page, 'd-' || k || '-' || lpad(CAST(page AS VARCHAR), 12, '0') AS part, rows, byte_length, sha256 FROM g_b), tp AS (SELECT kind, max(page) AS pages, CAST(sum(rows) AS BIGINT) AS rows FROM dp GROUP BY 1), "
    f"gr AS MATERIALIZED (SELECT kind, (pages - page) // 16 AS g, count(*) AS n, string_agg({_ref.replace('rows ||', 'dp.rows ||')}, ',' ORDER BY page) AS refs FROM dp JOIN tp USING (kind) GROUP BY 1, 2), "
    "ib(kind, g, part, rows, byte_length, sha256, ref) AS (SELECT kind, CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'null' FROM tp UNION ALL "
    f"SELECT kind, g, part, rows, byte_length, sha256, {_ref} FROM (SELECT kind, g, 'i-' || kind || '-' || lpad(CAST(g + 1 AS VARCHAR), 12, '0') AS part, n AS rows, strlen(body) AS byte_length, sha256(body) AS sha256 FROM (SELECT gr.kind, gr.g, gr.n, "
    """'{"schema_version":3,"kind":"page_index","release_id":"r1","table":"' || gr.kind || '","pages":[' || refs || '],"next":' || ib.ref || '}' AS body FROM ib JOIN gr ON gr.kind = ib.kind AND gr.g = ib.g + 1))), """
    """ti AS (SELECT kind, arg_max(ref, g) AS ref FROM ib GROUP BY 1), mk AS (SELECT string_agg('"' || kind || '":{"rows":' || rows || ',"pages":' || pages || ',"index":' || ref || '}', ',' ORDER BY CASE kind WHEN 'opinions' THEN 1 WHEN 'responses' THEN 2 ELSE 3 END) AS t FROM tp JOIN ti USING (kind)), """
    """mb AS (SELECT '{"schema_version":3,"format":"jsonl-pages-v1","release":{"id":"r1","prepared_at":"2026-01-01T00:00:00Z","cutoff":"2026-01-01T00:00:00Z","description":""},"updated_through":"2026-01-01T00:00:00Z","tables":{' || t || '}}' AS body FROM mk) """
    "SELECT part, rows AS row_count, byte_length, sha256 FROM dp UNION ALL SELECT part, rows, byte_length, sha256 FROM ib WHERE g >= 0 UNION ALL SELECT 'manifest', 1, strlen(body), sha256(body) FROM mb"
)


@query(
    with_views("planted", "first", "opinions", "impressions").replace("WITH ", "WITH RECURSIVE ", 1)[:-1] + ", me AS (SELECT id FROM opinions WHERE status = 'approved'), "
    """lo AS (SELECT 'opinions' AS k, row_number() OVER (ORDER BY created_at) AS rn, '{"id":"' || id || '","tag_id":"' || tag_id || '","source_ids":' || source_ids || ',"created_date":' || CASE WHEN created_at <> 0 THEN '"' || strftime(epoch_ms(created_at), '%Y-%m-%d') || '"' ELSE 'null' END || '}' AS line, id IN (FROM me) AS included FROM opinions), """
    f"lr AS (SELECT 'responses' AS k, row_number() OVER (ORDER BY session_id || opinion_id) AS rn, {_RESPONSE_LINE} AS line, opinion_id IN (FROM me) AS included FROM first JOIN opinions ON id = opinion_id), "
    """lp AS (SELECT 'presentations' AS k, row_number() OVER (ORDER BY session_id || opinion_id) AS rn, '{"session_id":"' || session_id || '","opinion_id":"' || opinion_id || '","displayed":' || bool_or(type = 'shown') || ',"answered":' || bool_or(type = 'answered') || ',"retired":' || bool_or(type = 'retired') || '}' AS line, opinion_id IN (FROM me) AS included FROM impressions GROUP BY session_id, opinion_id), """
    "al AS (FROM lo UNION ALL FROM lr UNION ALL FROM lp), " + _pages_sql("al", "g", 40_000)[:-1] + ", " + _INDEX
)
def release_build_parts(s: SparkSession, d: str) -> DataFrame:
    """A release of all three kinds, built in steps of a few blocks: its pages, indexes and root manifest."""
    built = release_build.Release(s, _folder(s), _release_sources(s, d), release_build.Sizes(page_bytes=40_000, index_refs=16, batch_blocks=8, batch_indexes=4))
    built.prepare("r1", 0, "2026-01-01T00:00:00Z")
    built.build(0)
    return built.every_part().select("part", "row_count", "byte_length", "sha256")


@query(FIRST[:-1] + ", n AS (SELECT count(*) AS rows FROM first), p AS (SELECT CAST(unnest(range(0, (SELECT (rows + 499) // 500 FROM n))) AS BIGINT) AS part), b AS (SELECT ((SELECT count(*) FROM p) - 1 - part) // 16 AS back, part FROM p) SELECT CAST(back AS BIGINT) AS \"index\", count(*) AS parts, min(part) AS first_part, CASE WHEN back > 0 THEN CAST(back - 1 AS BIGINT) END AS next FROM b GROUP BY back")
def page_index(s: SparkSession, d: str) -> DataFrame:
    n = _first(s, d).agg(F.count("*").alias("rows"))
    parts = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") + 499) / 500) - 1)).alias("part"))
    return release.page_index(parts, 16).select("index", F.size("parts").cast("long").alias("parts"), F.array_min("parts").alias("first_part"), "next")


_RELEASES = ", rl AS (SELECT o_orderkey AS id, o_orderdate AS published_at, CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN 'draft' ELSE 'invalid' END AS status FROM orders) "


def _releases(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "released").when(F.col("o_orderstatus") == "O", "draft").otherwise("invalid")
    return A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("published_at"), status.alias("status"))


@query(with_views()[:-1] + _RELEASES + "SELECT id, published_at FROM rl WHERE status = 'released' ORDER BY published_at DESC, id DESC LIMIT 1")
def latest_release(s: SparkSession, d: str) -> DataFrame:
    return release.latest(_releases(s, d)).select("id", "published_at")


@query("SELECT event_id, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 100")
def keyset_page(s: SparkSession, d: str) -> DataFrame:
    return release.keyset_page(A.table(s, d, "events").select("event_id", "user_id"), "event_id", 100, 100)


@query(with_views("opinions")[:-1] + ", op AS (SELECT id, status, CAST(created_at // 86400000 % 3 AS BIGINT) AS revision FROM opinions), fr AS (SELECT id, CAST(1 AS BIGINT) AS frozen FROM op) SELECT fr.id FROM fr LEFT JOIN op ON op.id = fr.id AND op.status = 'approved' WHERE op.id IS NULL OR op.revision <> frozen")
def unpublishable(s: SparkSession, d: str) -> DataFrame:
    at = A.opinions(s, d).select("id", "status", (F.floor(F.col("created_at") / 86400000) % 3).cast("long").alias("revision"))
    return release.publishable(at.select("id", F.lit(1).cast("long").alias("revision")), at)


@query(with_views("opinions")[:-1] + ", op AS (SELECT id, status, CAST(created_at // 86400000 % 3 AS BIGINT) AS revision FROM opinions), fr AS (SELECT id, CAST(1 AS BIGINT) AS frozen FROM op UNION ALL SELECT 'gone', 1) SELECT fr.id FROM fr LEFT JOIN op ON op.id = fr.id AND op.status = 'approved' WHERE op.id IS NULL OR op.revision <> frozen")
def unpublishable_map(s: SparkSession, d: str) -> DataFrame:
    """The same members, stored as one JSON object with one more that is gone."""
    at = A.opinions(s, d).select("id", "status", (F.floor(F.col("created_at") / 86400000) % 3).cast("long").alias("revision"))
    frozen = at.select("id").union(s.createDataFrame([("gone",)], "id string")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.lit(1))))).alias("opinion_revisions"))
    return release.publishable_map(frozen, at)


@query("SELECT c_custkey AS cursor, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS phase, max(c_custkey) OVER () AS next FROM (SELECT * FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 100)")
def admin_dump(s: SparkSession, d: str) -> DataFrame:
    """A page of sessions as an administrator may see them: by cursor, without the token."""
    rows = A.table(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("phase"), F.sha2("c_name", 256).alias("token_hash"))
    return moderation.dump("sessions", rows, "seq", 40)


@query(_COUNTED + "SELECT row_number() OVER (ORDER BY created_at, id) AS place, id FROM w WHERE status = 'pending' OR (status = 'approved' AND (unrelated - reviewed_unrelated >= 3 OR reports > reviewed_reports))")
def queue_order(s: SparkSession, d: str) -> DataFrame:
    rows = moderation.queue_order(_counted(s, d))
    return release.numbered(rows, ["created_at", "id"]).select(F.col("rn").alias("place"), "id")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def latest_actions(s: SparkSession, d: str) -> DataFrame:
    return moderation.latest(A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")), 100)


@query(with_views()[:-1] + _RELEASES + "SELECT id, published_at, status FROM rl ORDER BY published_at DESC, id DESC LIMIT 50")
def latest_releases(s: SparkSession, d: str) -> DataFrame:
    return moderation.latest(_releases(s, d), 50, "published_at")


@query(FIRST + "SELECT 1 AS id, (SELECT max(session_id) FROM first) AS snapshot_id, (SELECT count(*) FROM first) AS moderation, (SELECT count(DISTINCT session_id) FROM first) AS current_moderation, (SELECT CAST(count(*) AS VARCHAR) FROM first WHERE session_id = (SELECT max(session_id) FROM first)) AS payload")
def analysis_head(s: SparkSession, d: str) -> DataFrame:
    """The cache, the community and the snapshot it names as one row."""
    first = _first(s, d)
    cache = first.agg(F.max("session_id").alias("snapshot_id"), F.count("*").alias("moderation")).withColumn("id", F.lit(1))
    community = first.agg(F.count_distinct("session_id").alias("moderation_revision")).withColumn("id", F.lit(1))
    snapshots = first.groupBy(F.col("session_id").alias("id")).agg(F.count("*").cast("string").alias("payload"))
    return snapshot.head(cache, community, snapshots).select("id", "snapshot_id", "moderation", "current_moderation", "payload")


@query(with_views("planted", "first")[:-1] + ", op AS (SELECT DISTINCT opinion_id FROM first WHERE session_id LIKE '%1') SELECT (SELECT count(*) FROM (SELECT DISTINCT opinion_id FROM first) WHERE opinion_id NOT IN (FROM op)) = 0 AS same_opinions, (SELECT count(*) FROM planted WHERE value NOT IN (-1, 0, 1, 2)) = 0 AS values_known, (SELECT count(*) FROM (SELECT 1 FROM planted GROUP BY session_id, opinion_id HAVING count(*) > 1)) = 0 AS pairs_unique")
def fixture_checks(s: SparkSession, d: str) -> DataFrame:
    """Whether raw ballots are of the opinions that some sessions know, of known values and no pair twice."""
    known = _first(s, d).where("session_id like '%1'").select(F.col("opinion_id").alias("id")).distinct()
    return seed.check_fixture(A.ballots_planted(s, d), known)


@query(FIRST + "SELECT session_id, '{' || string_agg('\"' || opinion_id || '\":' || CAST(value AS VARCHAR), ',' ORDER BY opinion_id) || '}' AS votes FROM first GROUP BY 1")
def votes_by_opinion(s: SparkSession, d: str) -> DataFrame:
    """Each session's answers as one map."""
    at = _first(s, d).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("opinion_id", "value")))).alias("m"))
    return at.select("session_id", F.to_json("m").alias("votes"))


@query(FIRST[:-1] + ", p AS (SELECT session_id FROM first GROUP BY 1 ORDER BY 1 LIMIT 60), m AS (SELECT *, row_number() OVER (PARTITION BY opinion_id = 'O12' AND value = 1 ORDER BY session_id) AS k FROM first SEMI JOIN p USING (session_id)) SELECT session_id, opinion_id, value FROM m WHERE NOT (opinion_id = 'O12' AND value = 1) OR k <= 3")
def capped_prefix(s: SparkSession, d: str) -> DataFrame:
    """Answers of the first 60 sessions, with at most three of one opinion's minority."""
    return evaluate.minority_capped(evaluate.first_sessions(_first(s, d), 60), "O12", 1)


# States and streams


@query(with_views("opinions")[:-1] + ", ac AS (SELECT id, ['approve','reject','hide','restore','keep'][CAST(created_at // 86400000 % 5 AS INTEGER) + 1] AS action, CAST(created_at // 86400000 % 2 AS BIGINT) AS er FROM opinions), tr(a, f, t) AS (VALUES ('approve','pending','approved'), ('reject','pending','rejected'), ('hide','approved','hidden'), ('restore','hidden','approved'), ('restore','rejected','approved'), ('keep','approved','approved')) SELECT o.id, action, coalesce(t IS NOT NULL AND er = 0, false) AS applied, CASE WHEN t IS NOT NULL AND er = 0 THEN t ELSE status END AS next_status, CASE WHEN t IS NOT NULL AND er = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS next_revision FROM ac JOIN opinions o USING (id) LEFT JOIN tr ON a = action AND f = status")
def state_transitions(s: SparkSession, d: str) -> DataFrame:
    at = A.opinions(s, d)
    n = F.floor(F.col("created_at") / 86400000).cast("int")
    names = F.array(*(F.lit(a) for a in ("approve", "reject", "hide", "restore", "keep")))
    actions = at.select("id", F.element_at(names, n % 5 + 1).alias("action"), (n % 2).cast("long").alias("expected_revision"))
    return moderation.apply_actions(at.select("id", "status", F.lit(0).cast("long").alias("revision")), actions)


@query(with_views("impressions")[:-1] + ", l AS (SELECT opinion_id, type, lag(type) OVER (PARTITION BY opinion_id ORDER BY event_id) AS b FROM impressions) SELECT opinion_id, count(*) FILTER (WHERE b IS NOT NULL AND b <> type) AS revision FROM l GROUP BY 1")
def revision_counter(s: SparkSession, d: str) -> DataFrame:
    return E.revisions(A.impressions(s, d).select("opinion_id", F.col("event_id").alias("seq"), F.col("type").alias("state")))


@query(with_views("planted", "first", "opinions")[:-1] + ", nw AS (SELECT id, CASE status WHEN 'pending' THEN 'approved' WHEN 'approved' THEN CASE WHEN tag_id = 'T3' THEN 'hidden' ELSE status END ELSE status END AS status FROM opinions), f AS (SELECT session_id, sum(CAST(o.status = 'approved' AS INTEGER)) AS a, sum(CAST(n.status = 'approved' AS INTEGER)) AS z FROM first JOIN opinions o ON o.id = opinion_id JOIN nw n ON n.id = opinion_id GROUP BY 1) SELECT CAST(coalesce(sum(z - a), 0) AS BIGINT) AS votes, count(*) FILTER (WHERE z > 0) - count(*) FILTER (WHERE a > 0) AS sessions FROM f")
def approval_delta(s: SparkSession, d: str) -> DataFrame:
    before = A.opinions(s, d).select("id", "status", "tag_id")
    after = before.withColumn("status", F.when(F.col("status") == "pending", "approved").when((F.col("status") == "approved") & (F.col("tag_id") == "T3"), "hidden").otherwise(F.col("status")))
    return E.approval_delta(_first(s, d), before, after)


@query("SELECT event_id, user_id, event_type FROM events")
def event_dedup(s: SparkSession, d: str) -> DataFrame:
    """Events that arrive twice, taken once, as a stream."""
    rows = E.read_stream(s, d, "events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = E.distinct_events(rows.union(rows)).select("event_id", "user_id", "event_type")
    folder = _folder(s)
    E.append_stream(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return s.read.schema(out.schema).parquet(f"{folder}/out")


@query(FIRST + f"SELECT opinion_id, {ONE_COUNT} FROM first GROUP BY 1")
def counters_stream(s: SparkSession, d: str) -> DataFrame:
    """Counters kept by a stream of an answer log with removals: each answer comes, some go and
    come again."""
    folder = _folder(s)
    log = _first(s, d)
    more = log.where("opinion_id < 'O10'")
    signed = log.withColumn("sign", F.lit(1)).union(more.withColumn("sign", F.lit(-1))).union(more.withColumn("sign", F.lit(1)))
    signed.write.parquet(f"{folder}/log")
    name = "counters_" + folder.rpartition("-")[2].replace("-", "_")
    E.run_available(E.counters(E.read_stream(s, f"{folder}/log", "*.parquet")), f"{folder}/state", name).awaitTermination()
    return s.table(name)


@query(with_views("impressions") + "SELECT session_id, opinion_id, min(ts) AS displayed_at FROM impressions WHERE type = 'shown' GROUP BY 1, 2")
def first_display(s: SparkSession, d: str) -> DataFrame:
    return E.first_display(A.impressions(s, d))


@query(with_views("impressions") + "SELECT session_id, opinion_id, min(event_id) AS event_id FROM impressions WHERE type = 'retired' GROUP BY 1, 2")
def retirement_events(s: SparkSession, d: str) -> DataFrame:
    return E.retirements(A.impressions(s, d))


@query(with_views("impressions")[:-1] + ", o AS (SELECT session_id, opinion_id, max(event_id) FILTER (WHERE type = 'shown') AS shown FROM impressions GROUP BY 1, 2 HAVING bool_and(type = 'shown')) SELECT session_id, arg_max(opinion_id, shown) AS opinion_id, max(shown) AS event_id FROM o GROUP BY 1")
def outstanding_item(s: SparkSession, d: str) -> DataFrame:
    return E.outstanding(A.impressions(s, d))


@query(with_views("impressions") + "SELECT session_id, CASE WHEN count(*) FILTER (WHERE type = 'retired') > 0 THEN 'ended' WHEN count(*) FILTER (WHERE type = 'answered') >= 3 THEN 'reflect' ELSE 'active' END AS phase, min(event_id) FILTER (WHERE type = 'retired') AS ended_at FROM impressions GROUP BY 1")
def session_phase(s: SparkSession, d: str) -> DataFrame:
    return E.phases(A.impressions(s, d))


_LOG = "ev AS (SELECT event_id AS seq, lpad(CAST(user_id AS VARCHAR), 8, '0') AS s, 'O' || lpad(json_extract_string(props, '$.k'), 2, '0') AS o, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'answer' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'hide' ELSE 'restore' END WHEN 'purchase' THEN CASE json_extract_string(props, '$.k') WHEN '1' THEN 'finish' WHEN '2' THEN 'end' END END AS type FROM events)"


def _log(s: SparkSession, d: str) -> DataFrame:
    """The events as a log of commands and changes of approval."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, "hide").otherwise("restore"))
    kind = kind.when((F.col("event_type") == "purchase") & (k == "1"), "finish").when((F.col("event_type") == "purchase") & (k == "2"), "end")
    return A.table(s, d, "events").select(F.col("event_id").alias("seq"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("session_id"), kind.alias("type"), F.concat(F.lit("O"), F.lpad(k, 2, "0")).alias("opinion_id")).where("type is not null")


@query(
    f"WITH RECURSIVE {_LOG}, ch AS (SELECT o, seq, type = 'hide' AS hide FROM ev WHERE type IN ('hide', 'restore')), hi AS (SELECT o, seq FROM ch WHERE hide), "
    "c AS MATERIALIZED (SELECT e.s, e.seq, e.type, e.o, row_number() OVER (PARTITION BY e.s ORDER BY e.seq) AS i, coalesce(h.hide, false) AS hidden, u.seq AS until FROM (SELECT * FROM ev WHERE type IN ('request', 'answer', 'finish', 'end')) e ASOF LEFT JOIN ch h ON h.o = e.o AND h.seq < e.seq ASOF LEFT JOIN hi u ON u.o = e.o AND u.seq > e.seq), "
    "r(s, i, phase, card, until, answered, ret, ret_seq, kind, o, seq) AS (SELECT s, CAST(0 AS BIGINT), 'active', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT s FROM c) UNION ALL "
    "SELECT s, i, CASE kind WHEN 'reflect' THEN 'reflect' WHEN 'ended' THEN 'ended' ELSE phase END, CASE kind WHEN 'issued' THEN o WHEN 'answered' THEN NULL ELSE held END, CASE kind WHEN 'issued' THEN next_hide WHEN 'answered' THEN NULL ELSE CASE WHEN held IS NULL THEN NULL ELSE until END END, CASE kind WHEN 'answered' THEN list_append(answered, held) ELSE answered END, "
    "CASE WHEN gone THEN card END, CASE WHEN gone THEN until END, kind, CASE kind WHEN 'issued' THEN o WHEN 'answered' THEN held END, seq FROM (SELECT *, CASE WHEN type = 'request' AND phase = 'active' AND held IS NULL AND NOT hidden AND NOT list_contains(answered, o) THEN 'issued' WHEN type = 'answer' AND phase = 'active' AND held IS NOT NULL THEN 'answered' WHEN type = 'finish' AND phase = 'active' THEN 'reflect' WHEN type = 'end' AND phase <> 'ended' THEN 'ended' END AS kind "
    "FROM (SELECT *, CASE WHEN gone THEN NULL ELSE card END AS held FROM (SELECT c.s, c.i, c.seq, c.type, c.o, c.hidden, c.until AS next_hide, r.phase, r.card, r.until, r.answered, coalesce(r.card IS NOT NULL AND r.until < c.seq, false) AS gone FROM r JOIN c ON c.s = r.s AND c.i = r.i + 1)))) "
    "SELECT s AS session_id, o AS opinion_id, kind, seq FROM r WHERE kind IS NOT NULL UNION ALL SELECT s, ret, 'retired', ret_seq FROM r WHERE ret IS NOT NULL UNION ALL SELECT s, l.card, 'retired', l.until FROM (SELECT s, max_by(struct_pack(card := card, until := until), i) AS l FROM r GROUP BY 1) WHERE l.card IS NOT NULL AND l.until IS NOT NULL"
)
def session_machine(s: SparkSession, d: str) -> DataFrame:
    """Cards issued, answered and retired, and phases entered, by a keyed stream that is stopped half
    way and goes on from its state."""
    folder, log = _folder(s), _log(s, d)
    sessions.rocksdb(s)
    half = log.agg(F.max("seq")).first()[0] // 2
    for part in (log.where(F.col("seq") <= half), log.where(F.col("seq") > half)):
        for piece in E.pieces(part, "seq"):
            piece.write.mode("append").parquet(f"{folder}/log")
            out = sessions.machine(E.read_stream(s, f"{folder}/log", "*.parquet", 1 << 30), buckets=8)
            E.append_stream(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return s.read.parquet(f"{folder}/out").select("session_id", "opinion_id", "kind", "seq")


@query(with_views("planted", "first", "opinions")[:-1] + ", nw AS (SELECT id, CASE WHEN status = 'pending' THEN 'approved' WHEN tag_id = 'T3' THEN 'hidden' ELSE status END AS status FROM opinions) SELECT session_id, count(*) AS n FROM first JOIN nw ON id = opinion_id AND status = 'approved' WHERE opinion_id >= 'O15' OR opinion_id < 'O12' GROUP BY 1")
def counters_merged(s: SparkSession, d: str) -> DataFrame:
    """Approved answers of each session, merged from three batches: answers, then changes of approval and
    removals, then one that is merged again."""
    folder, first, at = _folder(s), _first(s, d), A.opinions(s, d)
    kept = Counters(s, f"{folder}/counters")
    none = lambda df: df.select(F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("session_id"), F.col("id").alias("opinion_id"), F.lit(None).cast("int").alias("value"), F.lit(None).cast("int").alias("sign"), F.col("approved"))
    answers = lambda df, seq, sign: df.select(F.lit(seq).cast("long").alias("seq"), "session_id", "opinion_id", F.col("value").cast("int").alias("value"), F.lit(sign).alias("sign"), F.lit(None).cast("boolean").alias("approved"))
    low = first.where("opinion_id < 'O15' and opinion_id >= 'O12'")
    after = at.withColumn("approved", F.when(F.col("status") == "pending", True).when(F.col("tag_id") == "T3", False).otherwise(F.col("status") == "approved"))
    batches = [none(at.withColumn("approved", F.col("status") == "approved")).union(answers(first, 1, 1)), none(after).withColumn("seq", F.lit(2).cast("long")).union(answers(low, 3, -1))]
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/log")
        kept.run(E.read_stream(s, f"{folder}/log", "*.parquet", 1), f"{folder}/state").awaitTermination()
    kept.merge(batches[1], kept.states.current()["batch"])
    return kept.table("sessions")


@query(
    with_views("opinions", "impressions")[:-1] + ", sh AS (SELECT session_id, opinion_id, event_id, row_number() OVER (PARTITION BY session_id, opinion_id ORDER BY event_id) AS k FROM impressions WHERE type = 'shown'), "
    "g AS (SELECT * FROM sh WHERE k = 1 AND opinion_id IN (SELECT id FROM opinions WHERE status = 'approved') AND NOT EXISTS (SELECT 1 FROM impressions r WHERE r.type = 'retired' AND r.session_id = sh.session_id AND r.opinion_id = sh.opinion_id)) "
    "SELECT session_id, opinion_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS sequence FROM g"
)
def guarded_append(s: SparkSession, d: str) -> DataFrame:
    """Cards that were shown, stored in two batches: once for each session and opinion, if the opinion is
    approved and the card wasn't retired, numbered in each session without gaps. A batch comes twice."""
    rows = A.impressions(s, d)
    shown = rows.where("type = 'shown'").select("session_id", "opinion_id", "event_id")
    approved = A.opinions(s, d).where("status = 'approved'").select(F.col("id").alias("opinion_id"))
    retired = rows.where("type = 'retired'").select("session_id", "opinion_id")
    book = ledger.Ledger(s, _folder(s), "session_id string, opinion_id string, event_id long", ["session_id", "opinion_id"], "session_id", ["event_id"])
    half = shown.agg(F.max("event_id")).first()[0] // 2
    guard = lambda new, _: ballots.guarded(new, [(approved, ["opinion_id"])], [(retired, ["session_id", "opinion_id"])])
    for number, part in ((0, shown.where(F.col("event_id") <= half)), (1, shown.where(F.col("event_id") > half)), (1, shown)):
        book.append(part, number, guard)
    return book.rows()


def _folder(s: SparkSession) -> str:
    """A new folder that executors share: under the checkpoint folder the session names."""
    return files.new_folder(s, "ballotry")
