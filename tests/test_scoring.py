"""Scalar scoring functions: reference cases and the published golden briefs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ranktide.functions import scoring as S
from ranktide.functions.util import ts_ntz

AS_OF = "2001-11-10 00:00:00"
NOW = dt.datetime(2001, 11, 10)


def _one(spark, expr, schema, row):
    df = spark.createDataFrame([row], schema)
    return df.select(expr.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("cvss,expected", [(10.0, 100.0), (5.0, 50.0), (None, 50.0)])
def test_severity(spark, cvss, expected):
    assert _one(spark, S.severity("c"), "c double", (cvss,)) == expected


@pytest.mark.parametrize(
    "fixed,summary,expected",
    [(["4.7.9"], "", 95.0), (["1.0.0"], "breaking rewrite", 60.0), ([], "x", 20.0), (None, None, 20.0),
     (["v2.0"], "ok", 95.0), (["next-1"], "ok", 70.0), ([""], "ok", 70.0), (["1.0"], "Removed API x", 60.0)],
)
def test_effort(spark, fixed, summary, expected):
    assert _one(spark, S.effort("f", "s"), "f array<string>, s string", (fixed, summary)) == expected


def test_blend_and_impact(spark):
    assert _one(spark, S.final_score(F.lit(80.0), F.lit(50.0), F.lit(40.0)), "a int", (1,)) == pytest.approx(66.5)
    assert _one(spark, S.impact(F.lit(50.0), F.lit(80.0)), "a int", (1,)) == pytest.approx(40.0)


@pytest.mark.parametrize("days,expected", [(None, 30.0), (14, 100.0), (365, 0.0), (189.5, 50.0), (400, 0.0), (1, 100.0)])
def test_confidence(spark, days, expected):
    ts = None if days is None else NOW - dt.timedelta(days=days)
    got = _one(spark, S.confidence(F.col("t"), ts_ntz(AS_OF)), "t timestamp_ntz", (ts,))
    assert got == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize(
    "d,s,expected",
    [(None, None, 0.0), (0, 0, 0.0), (50_581, None, 41.15996495), (1_531_453, 10, 60.36801027),
     (10**9, 10**6, 100.0), (100, 10_000, 41.53805173)],
)
def test_popularity(spark, d, s, expected):
    assert _one(spark, S.popularity("d", "s"), "d bigint, s bigint", (d, s)) == pytest.approx(expected, abs=1e-7)


@pytest.mark.parametrize(
    "downloads,cvss,days,impact,effort,conf,total",
    [
        (50_581, 9.8, 1_829, 40.3, 20, 0, 29.2),  # golden A
        (1_531_453, 8.7, 6, 47.1, 20, 100, 48.3),  # golden B
    ],
)
def test_golden_vulnerability_briefs(spark, downloads, cvss, days, impact, effort, conf, total):
    ts = NOW - dt.timedelta(days=days)
    df = spark.createDataFrame([(downloads, cvss, ts)], "d bigint, c double, t timestamp_ntz")
    imp = S.impact(S.popularity("d", F.lit(None).cast("bigint")), S.severity("c"))
    eff = S.effort(F.array().cast("array<string>"), F.lit(""))
    cf = S.confidence("t", ts_ntz(AS_OF))
    r = df.select(imp.alias("i"), eff.alias("e"), cf.alias("c"), S.final_score(imp, eff, cf).alias("s")).collect()[0]
    assert round(r.i, 1) == impact and r.e == effort and round(r.c) == conf and round(r.s, 1) == total


def test_golden_replacement_brief(spark):
    # downloads unknown, drop-in native replacement, fresh repo -> impact 0, effort 95, conf 100, total 38.8
    df = spark.createDataFrame([(None, ["pkg:npm/<native>"], "bloat", "drop-in", NOW)], "d bigint, t array<string>, a string, b string, ts timestamp_ntz")
    imp = S.impact(S.popularity("d", F.lit(None).cast("bigint")), S.replacement_severity("a", S.is_native("t")))
    eff = S.effort_band_score("b")
    cf = S.confidence("ts", ts_ntz(AS_OF))
    r = df.select(imp.alias("i"), eff.alias("e"), S.final_score(imp, eff, cf).alias("s")).collect()[0]
    assert r.i == 0 and r.e == 95 and round(r.s, 1) == 38.8


def test_score_macro_parity_with_blend(spark):
    ts = NOW - dt.timedelta(days=1)
    df = spark.createDataFrame([(7.5, 5_000_000, 10_000, ["1.2.3"], "fix", ts)], "c double, d bigint, s bigint, f array<string>, m string, t timestamp_ntz")
    r = df.select(S.score_macro("c", "d", "s", "f", "m", "t", ts_ntz(AS_OF)).alias("x")).collect()[0].x
    # popularity 82.6162, severity 75, effort 95, confidence 100
    assert r == pytest.approx(0.7592730, abs=1e-4)
    assert 0 <= r <= 1


def test_band_and_replacement_severity(spark):
    rows = [("drop-in", 95.0), ("minor-migration", 70.0), ("codemod-available", 60.0), ("rewrite", 20.0), ("weird", 50.0)]
    df = spark.createDataFrame(rows, "b string, e double")
    assert all(r.x == r.e for r in df.select(S.effort_band_score("b").alias("x"), "e").collect())
    df2 = spark.createDataFrame([(True, "perf", 75.0), (False, "perf", 60.0), (False, "bloat", 45.0)], "n boolean, a string, e double")
    assert all(r.x == r.e for r in df2.select(S.replacement_severity("a", "n").alias("x"), "e").collect())


def test_rounding_by_the_binary_value(spark):
    import random

    import duckdb

    from ranktide.catalog import sqlfn as Q
    from ranktide.functions.rounding import round_one_place

    random.seed(9)
    values = [random.uniform(0, 100) for _ in range(50_000)] + [i / 100 for i in range(10_000)] + [i / 8 for i in range(-400, 400)]
    values += [round(random.uniform(0, 100), 2) for _ in range(40_000)] + [0.35, 0.25, 0.05, 0.15, 2.675, -0.35, 99.95, 1e15 + 0.25, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, x double")
    got = {r.i: r.y for r in df.select("i", round_one_place("x").alias("y")).collect()}
    assert got.pop(-1) is None
    assert all(got[i] == round(v, 1) for i, v in enumerate(values))
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INT, x DOUBLE)")
    some = values[-1500:]
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(some)))
    assert all(y == round(some[i], 1) for i, y in con.execute(f"SELECT i, {Q.round_one_place('x')} FROM t").fetchall())
