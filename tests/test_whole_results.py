"""Queries that keep the rows with unknowns, against their DuckDB oracles on the smallest tables."""

import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, ".")
from tools.compare import rows_of  # noqa: E402

from ranktide.catalog.registry import load_all  # noqa: E402
from ranktide.sources.bridge import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("key", "unknown"), [("man_bench_signal", "bench_signal"), ("join_version_range", "latest")])
def test_rows_with_unknowns_stay(spark, key, unknown):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    entry = load_all()[key]
    df = entry.build(spark, SF)
    got, columns = rows_of(df.columns, df.collect())
    cur = con.execute(entry.sql)
    want, names = rows_of([x[0] for x in cur.description], cur.fetchall())
    assert columns == names and Counter(got) == Counter(want)
    some = [r for r in got if r[columns.index(unknown)] is None]
    assert 0 < len(some) < len(got)
    if key == "man_bench_signal":
        assert not any(r[columns.index("has_benchmarks")] for r in some)
        assert len(got) == con.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0]
