"""The files are read and parsed once, however many results come from them."""

from datetime import datetime

from pyspark.sql import functions as F

from ranktide.catalog.registry import load_all
from ranktide.plans import fanout as FO
from ranktide.sources import bridge as B
from ranktide.sources import manifests as MF

# order 13 is a monorepo with a lockfile (its dependencies are its importers'), 17 answers 404, 23 is no JSON
ORDERS = (1, 2, 11, 13, 17, 23, 39)


def _tables(spark, tmp_path) -> str:
    rows = [(o, 10 * o + n, o % 5 + 1, n, "R" if (o + n) % 4 == 0 else "N") for o in ORDERS for n in (1, 2, 3)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string")
    lines.withColumn("l_shipdate", F.lit(datetime(1996, 1, 1))).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _scans(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("parquet")


def test_direct_dependencies_and_their_locations_come_from_one_scan(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    one = _scans(B.repo_files(spark, sf))
    for key in ("man_direct_deps", "man_dep_locations", "man_bench_signal"):
        assert _scans(load_all()[key].build(spark, sf)) == one, key


def test_locations_without_requests_are_those_of_all_direct_names(spark, tmp_path):
    files = B.repo_files(spark, _tables(spark, tmp_path)).cache()
    _verdicts, names = MF.man_direct_deps(files)
    asked = {tuple(r) for r in MF.man_dep_locations(names, files).select("repo_url", "name", F.to_json(F.struct("locations"))).collect()}
    every = [tuple(r) for r in MF.man_dep_locations(None, files).select("repo_url", "name", F.to_json(F.struct("locations"))).collect()]
    assert set(every) == asked and len(every) == len(asked) > 5
    assert any(url.endswith("/order-13") and "packages/app" in at for url, _n, at in every)


def test_cases_by_names_in_arrays(spark, tmp_path):
    files = B.repo_files(spark, _tables(spark, tmp_path)).cache()
    url = "https://github.com/cust/order-"
    fan = spark.createDataFrame(
        [(f"pkg:npm/part-{10 * o + n}", f"pkg:npm/dep-{o}-{n}", f"{url}{o}.git") for o in ORDERS for n in (1, 2, 9)]
        + [("pkg:npm/part-11", "pkg:npm/none", None), ("pkg:npm/part-11", "pkg:npm/unseen", f"{url}999")],
        "from_purl string, dep_purl string, dep_repo_url string",
    )
    verdicts, names = MF.man_direct_deps(files)
    joined = {(r.dep_purl, r.dep_case, r.keep) for r in FO.flt_direct_dep_verdicts(fan, verdicts, names).collect()}
    arrays = FO.flt_direct_dep_verdicts(fan, MF.direct_deps(files), None)
    assert {(r.dep_purl, r.dep_case, r.keep) for r in arrays.collect()} == joined
    assert arrays.columns == FO.flt_direct_dep_verdicts(fan, verdicts, names).columns
    assert {"direct", "transitive", "unknown", "no_repo"} <= {c for _, c, _ in joined}


def test_workspaces_are_found_however_the_key_is_spelled(spark):
    rows = [("a", '{"workspaces": ["x"]}'), ("b", '{"\\u0077orkspaces": ["x"]}'), ("c", '{"dependencies": {}}'), ("d", '{"workspaces": []}')]
    files = spark.createDataFrame([(r, "package.json", 200, t) for r, t in rows], "repo_url string, path string, status int, text string")
    got = {r.repo_url: r.is_monorepo for r in MF.man_is_monorepo(files).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_bench_signals_go_by_repository_without_their_sections(spark, tmp_path):
    node = load_all()["man_bench_signal"].build(spark, _tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Aggregate":
        node = node.children().apply(0)
    assert "map<" not in node.child().schema().catalogString()


def test_bench_signals_however_they_are_spelled(spark):
    texts = {
        "a": ('{"scripts": {"\\u0062ench": "x"}}', "script:bench"), "b": ('{"scripts": {"BenCH:all": "x"}}', "script:BenCH:all"),
        "c": ('{"scripts": {"t": "VITEST  run bENch"}}', "script-cmd:t"), "d": ('{"scripts": {"t": "vitest; bench"}}', None),
        "e": ('{"scripts": [], "dependencies": {"mitata": "1"}}', "devDep:mitata"), "f": ('{"devDependencies": {"\\u006ditata": "1"}}', "devDep:mitata"),
        "g": ('{"dependencies": {"tinybench": "1"}, "devDependencies": {"benchmark": "1", "mitata": 2}}', "devDep:mitata"),
        "h": ('{"dependencies": {"x": "tinybench", "Benchmark": "1"}}', None), "i": ('{"scripts": {"bench": "x"}', None), "j": ("[1]", None),
    }
    rows = [(r, "package.json", 200, t) for r, (t, _) in texts.items()] + [("k", "yarn.lock", 404, None), ("l", "package.json", 404, '{"scripts": {"bench": ""}}')]
    got = MF.man_bench_signal(spark.createDataFrame(rows, "repo_url string, path string, status int, text string")).collect()
    want = {r: s for r, (_, s) in texts.items()} | {"k": None, "l": None}
    assert {r.repo_url: (r.has_benchmarks, r.bench_signal) for r in got} == {r: (s is not None, s) for r, s in want.items()}
