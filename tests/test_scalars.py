import math

import pytest
from pyspark.sql import functions as F

from ballotry.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("agree", "seen", "ok"), [(8, 10, False), (9, 10, True), (14, 20, False), (15, 20, True), (59, 100, False), (60, 100, True), (3, 3, False), (9, 9, False)])
def test_evidence_boundaries(spark, agree, seen, ok):
    assert one(spark, S.has_evidence(F.lit(agree), F.lit(seen))) is ok


def test_wilson(spark):
    assert one(spark, S.wilson_lower(F.lit(0), F.lit(0))) == 0
    assert one(spark, S.wilson_lower(F.lit(7), F.lit(10), 0)) == pytest.approx(0.7)
    with pytest.raises(Exception, match="invalid counts"):
        one(spark, S.wilson_lower(F.lit(5), F.lit(3)))
    with pytest.raises(ValueError):
        S.wilson_lower("a", "b", 11)


def plain_hash(text, salt):
    v = (2166136261 ^ salt) & 0xFFFFFFFF
    units = text.encode("utf-16-be")
    for c in (int.from_bytes(units[i : i + 2]) for i in range(0, len(units), 2)):
        v = (v ^ c) * 16777619 & 0xFFFFFFFF
    v = (v ^ v >> 16) * 0x7FEB352D & 0xFFFFFFFF
    v = (v ^ v >> 15) * 0x846CA68B & 0xFFFFFFFF
    return v ^ v >> 16


@pytest.mark.parametrize("text", ["", "a", "session-00042", "zzzzzzzzzzzzzzzzzzzzzzzzzzzz", "é", "日本", "😀", "a😀é𝒳z"])
def test_text_hash(spark, text):
    assert one(spark, S.text_hash(F.lit(text), 0x6A09E667)) == plain_hash(text, 0x6A09E667)


def plain_draws(seed, n):
    out, state = [], seed
    for _ in range(n):
        state = state + 0x6D2B79F5 & 0xFFFFFFFF
        v = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        v ^= v + ((v ^ v >> 7) * (v | 61) & 0xFFFFFFFF) & 0xFFFFFFFF
        out.append((v ^ v >> 14) / 4294967296)
    return out


def test_random_access_draws(spark):
    want = plain_draws(20260918, 5)
    assert [one(spark, S.random_at(F.lit(20260918), k)) for k in range(5)] == want


def test_days_and_checks(spark):
    assert one(spark, S.local_day(F.lit(15 * 3600 * 1000).cast("long"))) == "1970-01-02"
    assert one(spark, S.iso_day(F.lit(0).cast("long"))) is None
    assert one(spark, S.is_uuid(F.lit("0" * 36))) and not one(spark, S.is_uuid(F.lit(None).cast("string")))
    assert one(spark, S.is_opinion_text(F.lit(" short "))) is False
    rows = spark.createDataFrame([(1.0, math.inf), (1.0, 2.0), (math.nan, 1.0), (None, 1.0)], "x double, y double")
    assert rows.where(S.finite("x", "y")).count() == 1
