"""A sample of registered queries against their DuckDB oracles on the smallest tables."""

import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, ".")
from tools.compare import rows_of  # noqa: E402

from ranktide.catalog.registry import load_all  # noqa: E402
from ranktide.sources.bridge import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = ["mart_opportunities", "mart_opportunity_state", "fn_version_in_range", "src_advisories_flatten", "join_tiered_source",
        "man_dep_lines", "man_direct_deps", "src_manifest_line_index", "aud_runner", "top_fanout"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    e = load_all()[key]
    df = e.build(spark, SF)
    s, sc = rows_of(df.columns, df.collect())
    cur = con.execute(e.sql)
    d, dc = rows_of([x[0] for x in cur.description], cur.fetchall())
    assert sc == dc
    assert Counter(s) == Counter(d)
