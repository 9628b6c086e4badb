"""Versioned tables: merges by bucket, concurrent writers, crashes, write-audit-publish, incremental lifecycle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ranktide.operators import audits as A
from ranktide.plans import marts as M
from ranktide.sources import dependents as D
from ranktide.sources import versions as V

AT = dt.datetime(2024, 1, 1)


def cache_rows(spark, rows):
    data = [("npm", name, week, [(f"d{i}", f"p{i}", None, i) for i in range(n)], AT + dt.timedelta(days=day)) for name, week, n, day in rows]
    return spark.createDataFrame(data, D.CACHE_DDL)


def content(df):
    return sorted((r["name"], r["iso_week"], len(r["payload"])) for r in df.collect())


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    table = D.cache_table(spark, str(tmp_path), buckets=8)
    assert table.read().count() == 0
    D.cache_upsert(table, cache_rows(spark, [(f"n{i}", "W1", 1, 0) for i in range(40)]))
    _, before = table.versions.current()
    D.cache_upsert(table, cache_rows(spark, [("n3", "W1", 4, 1), ("n3", "W2", 0, 1), ("n5", "W1", 9, -1)]))
    number, after = table.versions.current()
    assert number == 2 and 1 <= sum(before[b] != after[b] for b in after) <= 2
    got = content(table.read())
    assert ("n3", "W1", 4) in got and ("n3", "W2", 0) in got and ("n5", "W1", 1) in got and len(got) == 41
    assert content(table.read(1)) == sorted((f"n{i}", "W1", 1) for i in range(40))
    assert D.cache_upsert(table, cache_rows(spark, [])) == 2


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    """One week is published while another is being merged: the second begins again on top of it."""
    table = D.cache_table(spark, str(tmp_path), buckets=4)
    D.cache_upsert(table, cache_rows(spark, [("a", "W1", 1, 0), ("b", "W1", 1, 0)]))
    other, new, calls = D.cache_table(spark, str(tmp_path), buckets=4), cache_rows(spark, [("a", "W3", 3, 0)]), []

    def combine(rows):
        if not calls:
            calls.append(D.cache_upsert(other, cache_rows(spark, [("a", "W2", 2, 0), ("c", "W2", 2, 0)])))
        return D.newest(rows.unionByName(new))

    assert table.update(lambda rows: new.select("system", "name"), combine) == 3 and calls == [2]
    assert content(table.read()) == [("a", "W1", 1), ("a", "W2", 2), ("a", "W3", 3), ("b", "W1", 1), ("c", "W2", 2)]


def test_a_crash_before_the_swap_loses_nothing(spark, tmp_path, monkeypatch):
    table = D.cache_table(spark, str(tmp_path), buckets=4)
    D.cache_upsert(table, cache_rows(spark, [("a", "W1", 1, 0)]))
    with monkeypatch.context() as m:
        m.setattr(table.versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            D.cache_upsert(table, cache_rows(spark, [("a", "W1", 5, 9), ("z", "W9", 1, 0)]))
    assert content(table.read()) == [("a", "W1", 1)]
    D.cache_upsert(table, cache_rows(spark, [("a", "W1", 5, 9)]))
    assert content(table.read()) == [("a", "W1", 5)]


def test_a_version_is_published_once(spark, tmp_path):
    v = V.Versions(spark, str(tmp_path))
    assert v.current() == (0, {}) and v.publish(1, {"a": "x"}) and not v.publish(1, {"a": "y"})
    assert v.current() == (1, {"a": "x"}) and v.numbers() == [1]


def models(spark, **changed):
    day, at = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)
    rows = {
        "staging.advisories": ("id string, project_purl string, ingest_date date", [("i", "p", day)]),
        "staging.projects": ("purl string, ecosystem string, name string, archived boolean, ingest_date date", [("p", "npm", "n", False, day), ("old", "npm", "o", True, day)]),
        "staging.opportunity_transitions": ("dedupe_key string, to_state string, transitioned_at timestamp_ntz, ingest_date date", [("p|i", "new", at, day)]),
        "staging.dependents": ("parent_purl string, dependent_purl string, ingest_date date", [("p", "d", day)]),
        "staging.replacements": ("id string, from_purl string, axis string, effort string, ingest_date date", [("r", "p", "perf", "drop-in", day)]),
        "marts.opportunities": ("id string, kind string, project_purl string, dedupe_key string, score double", [("i", "k", "p", "p|i", 0.5)]),
        "marts.opportunity_state": ("dedupe_key string, kind string, project_purl string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, state string", [("p|i", "k", "p", at, at, "new")]),
    }
    return {k: spark.createDataFrame(data + changed.get(k, []), ddl) for k, (ddl, data) in rows.items()}


DAY, NOW = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)
BAD = [  # one row, or two, that violate each of the audits
    ("staging.advisories", "not_null", [(None, "p", DAY)]), ("staging.advisories", "unique_combination_of_columns", [("i", "q", DAY)]),
    ("staging.projects", "not_null", [("q", None, "n", False, DAY)]),
    ("staging.opportunity_transitions", "not_null", [(None, "new", NOW, DAY)]), ("staging.opportunity_transitions", "valid_to_state", [("x", "odd", NOW, DAY)]),
    ("staging.dependents", "not_null", [("p", None, DAY)]), ("staging.dependents", "unique_combination_of_columns", [("p", "d", DAY)]),
    ("staging.replacements", "not_null", [("s", "p", None, "e", DAY)]), ("staging.replacements", "unique_combination_of_columns", [("r", "p", "bloat", "e", DAY)]),
    ("marts.opportunities", "not_null", [("j", None, "p", "p|j", 0.1)]), ("marts.opportunities", "unique_values", [("i", "k", "p", "p|j", 0.1)]),
    ("marts.opportunities", "score_in_range", [("j", "k", "p", "p|j", 1.5)]), ("marts.opportunities", "no_archived_active_opps", [("j", "k", "old", "p|j", 0.1)]),
    ("marts.opportunity_state", "not_null", [("p|j", None, "p", NOW, NOW, "new")]), ("marts.opportunity_state", "unique_values", [("p|i", "k", "p", NOW, NOW, "new")]),
    ("marts.opportunity_state", "valid_opportunity_state", [("p|j", "k", "p", NOW, NOW, "gone")]),
]


def test_every_audit_blocks_a_publish(spark, tmp_path):
    v = V.Versions(spark, str(tmp_path))
    V.write_audit_publish(v, models(spark), A.block)
    assert len(A.model_audits(models(spark))) == len(BAD) == 16
    everything = {}
    for model, _, rows in BAD:
        everything.setdefault(model, []).extend(rows)
    with pytest.raises(AssertionError) as failed:
        V.write_audit_publish(v, models(spark, **everything), A.block)
    for model, audit, rows in BAD:
        assert f"('{audit}', '{model}', " in str(failed.value)
    for model, audit, rows in BAD[1::4]:  # each alone, too
        some = models(spark, **{model: rows})
        assert [(a, m) for a, m, n in ((r.audit, r.model, r.violations) for r in A.run_audits(A.model_audits(some), some).collect()) if n] == [(audit, model)]
    assert v.current()[0] == 1 and V.read_model(v, "marts.opportunities").count() == 1


def test_one_scan_a_model(spark, tmp_path):
    models(spark)["marts.opportunities"].write.parquet(str(tmp_path / "m"))
    mart = spark.read.parquet(str(tmp_path / "m"))
    own = [a for a in A.model_audits({"marts.opportunities": mart})]
    plan = A.audit_model(mart, own)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(own) == 3 and plan.count("FileScan") == 1


def advisories(spark, rows):
    return spark.createDataFrame([(p, i, dt.date(2024, 1, d)) for p, i, d in rows], "project_purl string, id string, ingest_date date")


def same(table, landed):
    want = M.agg_lifecycle(landed)
    key = lambda r: (r["project_purl"] or "", r["id"] or "", r["first_seen"], r["last_seen"], r["partition_count"])
    assert sorted(map(key, M.read_lifecycle(table).collect())) == sorted(map(key, want.collect()))


def test_increments_equal_a_full_build(spark, tmp_path):
    table = M.lifecycle_table(spark, str(tmp_path), buckets=8)
    rows = [(f"p{i % 7}", f"i{i % 11}" if i % 13 else None, 1 + i % 5) for i in range(120)]
    landed = advisories(spark, rows)
    for d in (3, 1, 2, 5, 4):
        M.update_lifecycle(table, landed, [dt.date(2024, 1, d)])
        M.update_lifecycle(table, landed, [dt.date(2024, 1, d)])  # again: nothing changes
    same(table, landed)
    # Day 2 is landed again with other rows, day 4 with none.
    again = advisories(spark, [r for r in rows if r[2] not in (2, 4)] + [("p0", "new", 2), ("p1", "i1", 2)])
    M.update_lifecycle(table, again, [dt.date(2024, 1, 2), dt.date(2024, 1, 4)])
    same(table, again)
    assert M.update_lifecycle(table, again, []) == table.versions.current()[0]


def test_only_touched_dates_are_read(spark, tmp_path, monkeypatch):
    rows = [("p", "i", d) for d in range(1, 6)]
    advisories(spark, rows).withColumn("dt", F.col("ingest_date")).write.partitionBy("dt").parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed")).withColumn("ingest_date", F.col("dt").cast("date"))
    plans = []
    keep = M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    M.update_lifecycle(M.lifecycle_table(spark, str(tmp_path / "t"), 4), landed, [dt.date(2024, 1, 3)])
    filters = plans[0].split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "dt" in filters and "2024-01-03" in filters
