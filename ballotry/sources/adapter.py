"""Views of the given tables in this domain: ballots, opinions, reports, events, points.

Ballots are lines of orders: the session is the customer, the opinion the part's brand.
All are lazy projections and joins that Catalyst prunes and pushes down; part is joined by
its key without a hint, so that Spark broadcasts it only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of the rows of lineitem, in place of an arrival order.
ARRIVAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number() -> Column:
    return F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*ARRIVAL)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _number().alias("b"))
    at = lines.join(orders, "l_orderkey").join(parts, "l_partkey")
    return at.select(F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("session_id"), F.concat(F.lit("O"), F.lpad(F.col("b").cast("string"), 2, "0")).alias("opinion_id"), "o_custkey", "b", F.struct(*ARRIVAL).alias("arrival"))


def ballots_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, opinion_id, value, arrival): agree -1, disagree 1, pass 0."""
    value = F.when(F.col("arrival.l_returnflag") == "A", -1).when(F.col("arrival.l_returnflag") == "R", 1).otherwise(0)
    return _lines(spark, sf_dir).select("session_id", "opinion_id", value.alias("value"), "arrival")


def ballots_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballots with two opposite groups of sessions and common items all agree on; value 2 is
    unrelated."""
    side = F.when(F.col("o_custkey") % 2 == F.col("b") % 2, -1).otherwise(1)
    common = F.col("b") % 5 == 2
    flip = F.when(F.col("arrival.l_linenumber") == 7, -1).otherwise(1)
    value = F.when(~common & (F.col("arrival.l_quantity") >= 48), 2).when(~common & (F.col("arrival.l_quantity") <= 3), 0).when(common, -flip).otherwise(side * flip)
    return _lines(spark, sf_dir).select("session_id", "opinion_id", value.alias("value"), "arrival")


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tag_id, status, author_session, created_at, reviewed_unrelated, reviewed_reports,
    source_ids): one opinion for each brand, with fixed properties of its number."""
    parts = table(spark, sf_dir, "part").groupBy(_number().alias("b")).agg(F.count("*").alias("_n"))
    status = F.element_at(F.array(*(F.lit(s) for s in ("approved", "approved", "hidden", "approved", "pending", "rejected", "approved"))), F.col("b") % 7 + 1)
    return parts.select(
        F.concat(F.lit("O"), F.lpad(F.col("b").cast("string"), 2, "0")).alias("id"), F.concat(F.lit("T"), (F.col("b") % 8).cast("string")).alias("tag_id"), status.alias("status"),
        F.when(F.col("b") % 3 == 0, F.lpad((F.col("b") * 2).cast("string"), 8, "0")).alias("author_session"), (F.col("b").cast("long") * 86400000).alias("created_at"),
        (F.col("b") % 4).cast("long").alias("reviewed_unrelated"), (F.col("b") % 2).cast("long").alias("reviewed_reports"), F.concat(F.lit('["s'), F.col("b").cast("string"), F.lit('","s0"]')).alias("source_ids"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, session_id, opinion_id, category, created_at): returns of the last line numbers."""
    rows = _lines(spark, sf_dir).where("arrival.l_linenumber >= 6 and arrival.l_quantity < 10 and b % 6 != 1")
    category = F.when(F.col("arrival.l_returnflag") == "A", "abuse").when(F.col("arrival.l_returnflag") == "R", "spam").otherwise("other")
    one = rows.groupBy("session_id", "opinion_id").agg(F.min(F.struct("arrival", category.alias("category"))).alias("first"))
    return one.select("session_id", "opinion_id", "first.category")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, session_id, opinion_id, type, ts): type shown, answered or retired."""
    kind = F.when(F.col("event_type") == "view", "shown").when(F.col("event_type") == "click", "answered").when(F.col("event_type") == "error", "retired")
    rows = table(spark, sf_dir, "events").select("event_id", F.lpad(F.col("user_id").cast("string"), 8, "0").alias("session_id"), F.concat(F.lit("O"), F.lpad(F.get_json_object("props", "$.k"), 2, "0")).alias("opinion_id"), kind.alias("type"), "ts")
    return rows.where(F.col("type").isNotNull())


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, label): two coordinates of the labelled vectors."""
    return table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


#: The same views in SQL, as common table expressions for the independent check.
SQL = {
    "lines": "lines AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS session_id, 'O' || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 2, '0') AS opinion_id, o_custkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS b, l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)",
    "raw": "raw AS (SELECT *, CASE l_returnflag WHEN 'A' THEN -1 WHEN 'R' THEN 1 ELSE 0 END AS value FROM lines)",
    "planted": "planted AS (SELECT *, CASE WHEN b % 5 <> 2 AND l_quantity >= 48 THEN 2 WHEN b % 5 <> 2 AND l_quantity <= 3 THEN 0 WHEN b % 5 = 2 THEN CASE WHEN l_linenumber = 7 THEN 1 ELSE -1 END ELSE (CASE WHEN o_custkey % 2 = b % 2 THEN -1 ELSE 1 END) * (CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END) END AS value FROM lines)",
    "opinions": "opinions AS (SELECT DISTINCT 'O' || lpad(CAST(b AS VARCHAR), 2, '0') AS id, 'T' || CAST(b % 8 AS VARCHAR) AS tag_id, ['approved','approved','hidden','approved','pending','rejected','approved'][b % 7 + 1] AS status, CASE WHEN b % 3 = 0 THEN lpad(CAST(b * 2 AS VARCHAR), 8, '0') END AS author_session, b * CAST(86400000 AS BIGINT) AS created_at, CAST(b % 4 AS BIGINT) AS reviewed_unrelated, CAST(b % 2 AS BIGINT) AS reviewed_reports, '[\"s' || CAST(b AS VARCHAR) || '\",\"s0\"]' AS source_ids FROM (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS b FROM part))",
    "reports": "reports AS (SELECT session_id, opinion_id, CASE l_returnflag WHEN 'A' THEN 'abuse' WHEN 'R' THEN 'spam' ELSE 'other' END AS category FROM (SELECT *, row_number() OVER (PARTITION BY session_id, opinion_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS rn FROM lines WHERE l_linenumber >= 6 AND l_quantity < 10 AND b % 6 <> 1) WHERE rn = 1)",
    "impressions": "impressions AS (SELECT event_id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS session_id, 'O' || lpad(json_extract_string(props, '$.k'), 2, '0') AS opinion_id, CASE event_type WHEN 'view' THEN 'shown' WHEN 'click' THEN 'answered' ELSE 'retired' END AS type, ts FROM events WHERE event_type IN ('view', 'click', 'error'))",
    "points": "points AS (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)",
}
_ORDER = ", ".join(ARRIVAL)
#: Ballots after the two duplicate rules, eligible sessions and kept opinions, over a source.
SQL |= {
    "valid": "valid AS (SELECT session_id, opinion_id, value FROM (SELECT *, row_number() OVER (PARTITION BY session_id, opinion_id ORDER BY " + ", ".join(f"{c} DESC" for c in ARRIVAL) + ") AS rn FROM {source} WHERE value IN (-1, 0, 1)) WHERE rn = 1)",
    "first": f"first AS (SELECT session_id, opinion_id, value FROM (SELECT *, row_number() OVER (PARTITION BY session_id, opinion_id ORDER BY {_ORDER}) AS rn FROM {{source}}) WHERE rn = 1)",
    "eligible": "eligible AS (SELECT session_id, count(*) FILTER (WHERE value <> 0) AS substantive FROM valid GROUP BY session_id HAVING count(*) FILTER (WHERE value <> 0) >= 6)",
    "kept": "kept AS (SELECT opinion_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS s, CAST(sum(value) AS DOUBLE) / count(*) AS mean FROM valid SEMI JOIN eligible USING (session_id) GROUP BY opinion_id HAVING count(*) >= 3)",
}


def with_views(*names: str, source: str = "planted") -> str:
    """WITH ... for the named views, in order, after the lines they all come from."""
    return "WITH " + ", ".join(SQL[n].replace("{source}", source) for n in ("lines", *names)) + " "
