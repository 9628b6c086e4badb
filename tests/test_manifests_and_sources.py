"""Repository manifests (F10), dependents tiers and cache (F12), landing (F2), brief rendering (F13)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from ranktide.operators import lines as LN
from ranktide.plans import fanout as FO
from ranktide.sources import dependents as D
from ranktide.sources import landing as LD
from ranktide.sources import manifests as MF

PKG = """{
  "name": "x",
  "dependencies": {
    "a": "^1",
    "b": "^2"
  },
  "overrides": {
    "c": "1"
  },
  "devDependencies": {
    "c": "^3"
  },
  "scripts": {"test:perf": "vitest bench src/", "ci": "vitest run && bench"}
}"""

LOCK = """lockfileVersion: '9.0'
importers:
  .:
    dependencies:
      eslint:
        specifier: ^8
  packages/app:
    devDependencies:
      '@scope/jose': 1.0.0
      expo:
        version: 1
packages:
  transitive@1.0.0:
    resolution: {}
"""


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo_url string, path string, status int, text string")


def test_dep_lines_and_sections(spark):
    f = _files(spark, [("r", "package.json", 200, PKG)])
    got = {(r.name, r.line) for r in MF.man_dep_lines(f).collect()}
    assert got == {("a", 4), ("b", 5), ("c", 11)}  # the overrides decoy on line 8 does not count


def test_lockfile_importers(spark):
    f = _files(spark, [("r", "pnpm-lock.yaml", 200, LOCK)])
    got = sorted((r.workspace, r.section, r.dep) for r in MF.lockfile_importers(f).collect())
    assert got == [(".", "dependencies", "eslint"), ("packages/app", "devDependencies", "@scope/jose"), ("packages/app", "devDependencies", "expo")]


def test_direct_dep_verdicts(spark):
    mono = json.dumps({"name": "m", "workspaces": {"packages": ["p/*"]}})
    rows = [
        ("single", "package.json", 200, PKG),
        ("mono_lock", "package.json", 200, mono), ("mono_lock", "pnpm-lock.yaml", 200, LOCK),
        ("mono_nolock", "package.json", 200, json.dumps({"workspaces": ["a"]})), ("mono_nolock", "pnpm-lock.yaml", 404, None),
        ("notjs", "package.json", 404, None), ("notjs", "pnpm-lock.yaml", 404, None), ("notjs", "yarn.lock", 404, None),
        ("lock_only", "package.json", 404, None), ("lock_only", "yarn.lock", 200, None),
        ("transient", "package.json", 500, None),
        ("badjson", "package.json", 200, "{not json"),
    ]
    v, n = MF.man_direct_deps(_files(spark, rows))
    verdicts = {r.repo_url: r.verdict for r in v.collect()}
    assert verdicts == {"single": "set", "mono_lock": "set", "mono_nolock": "monorepo", "notjs": "not_js",
                        "lock_only": "unknown", "transient": "unknown", "badjson": "unknown"}
    names = {(r.repo_url, r.name) for r in n.collect()}
    assert ("single", "c") in names and ("mono_lock", "expo") in names and ("mono_lock", "transitive") not in names


def test_bench_signal_priority(spark):
    rows = [
        ("cmd", "package.json", 200, PKG),
        ("name", "package.json", 200, json.dumps({"scripts": {"build": "x", "Bench": "node b.js"}, "devDependencies": {"tinybench": "1"}})),
        ("lib", "package.json", 200, json.dumps({"dependencies": {"mitata": "1"}, "devDependencies": {"benchmark": "1"}})),
        ("none", "package.json", 200, json.dumps({"scripts": {"ci": "jest && bench"}})),
        ("gone", "package.json", 404, None),
    ]
    got = {r.repo_url: r.bench_signal for r in MF.man_bench_signal(_files(spark, rows)).collect()}
    assert got == {"cmd": "script-cmd:test:perf", "name": "script:Bench", "lib": "devDep:benchmark", "none": None, "gone": None}


def test_filter_cases(spark):
    fan = spark.createDataFrame(
        [("pkg:npm/a", "d1", None), ("pkg:npm/a", "d2", "single"), ("pkg:npm/zzz", "d3", "single"),
         ("pkg:npm/a", "d4", "notjs"), ("pkg:npm/a", "d5", "mono_nolock"), ("pkg:npm/a", "d6", "unknown-repo")],
        "from_purl string, dep_purl string, dep_repo_url string",
    )
    files = _files(spark, [("single", "package.json", 200, PKG), ("notjs", "package.json", 404, None),
                           ("notjs", "yarn.lock", 404, None), ("mono_nolock", "package.json", 200, json.dumps({"workspaces": ["a"]}))])
    v, n = MF.man_direct_deps(files)
    cases = {r.dep_purl: (r.dep_case, r.keep) for r in FO.flt_direct_dep_verdicts(fan, v, n).collect()}
    assert cases == {"d1": ("no_repo", True), "d2": ("direct", True), "d3": ("transitive", False),
                     "d4": ("not_js", False), "d5": ("monorepo", True), "d6": ("unknown", True)}
    c = FO.agg_filter_counters(FO.flt_direct_dep_verdicts(fan, v, n)).collect()[0]
    assert (c.kept, c.dropped, c.unknown, c.monorepo, c.not_js) == (4, 2, 2, 1, 1)
    off = FO.flt_direct_dep_verdicts(fan, None, None)
    assert off.where("keep").count() == 6


def test_tiers_cache_and_empty_hit(spark):
    req = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "name string")
    cache = spark.createDataFrame(
        [("npm", "p1", "2024-W03", [("c", "pkg:npm/c", None, 1)] * 7, None), ("npm", "p4", "2024-W03", [], None),
         ("npm", "p2", "2024-W02", [("old", "pkg:npm/old", None, 1)], None)],
        "system string, name string, iso_week string, payload array<struct<name:string,purl:string,repo_url:string,lifetime_downloads:bigint>>, written_at timestamp_ntz",
    )
    edge = "parent string, name string, purl string, repo_url string, lifetime_downloads bigint, rank int"
    prim = spark.createDataFrame([("p1", "x", "pkg:github/x", None, None, 1), ("p2", "y", "pkg:github/y", None, None, 1)], edge)
    fb = spark.createDataFrame([("p2", "z", "pkg:npm/z", None, 5, 1), ("p3", "w", "pkg:npm/w", None, 5, 1)], edge)
    t = D.join_tiered_source(req, cache, prim, fb, "2024-W03", k=5)
    got = sorted((r.parent, r.tier) for r in t.collect())
    # p1: cache hit cut to k=5; p2: other week is a miss -> primary; p3: fallback; p4: empty hit -> nothing.
    assert got == [("p1", 0)] * 5 + [("p2", 1), ("p3", 2)]


def test_landing_empty_schema_and_overwrite(spark):
    root = tempfile.mkdtemp(prefix="ranktide-test-land-")
    empty = spark.createDataFrame([], LD.struct_type("advisories"))
    LD.land_snapshot(empty, root, "advisories", "2026-01-02")
    assert os.listdir(f"{root}/advisories/dt=2026-01-02")
    assert LD.read_landed(spark, root, "advisories").count() == 0
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("pkg:npm/a").alias("project_purl"))
    for c, t in LD.SCHEMAS["advisories"]:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t))
    LD.land_snapshot(rows, root, "advisories", "2026-01-02")
    LD.land_snapshot(rows.limit(1), root, "advisories", "2026-01-02")
    d = LD.stage(spark, root, "advisories", "2026-01-01", "2026-01-31")
    assert d.count() == 1 and d.first().ingest_date.isoformat() == "2026-01-02"


def test_running_sum_chunked_matches_plain(spark):
    lines = spark.createDataFrame([("d", i, "{" * (i % 3) + "}" * (i % 2)) for i in range(1, 200)], "doc string, line_no int, line string")
    x = lines.withColumn("delta", LN.count_char(F.col("line"), "{") - LN.count_char(F.col("line"), "}"))
    a = {r.line_no: r.d for r in LN.running_sum_chunked(x, ["doc"], "delta", "d", chunk=7).collect()}
    b = {r.line_no: r.d_before for r in LN.with_depth(lines, ["doc"]).collect()}
    assert a == b


MANIFEST = """{
  "mappings": {
    "is-number": {
      "type": "module",
      "replacements": ["doc-id"]
    },
    "other": {"type": "x"},
    "is-nan": {
      "type": "module",
      "replacements": ["native-id"]
    }
  },
  "replacements": {
    "doc-id": {"id": "doc-id", "type": "documented", "replacementModule": "better-num"},
    "native-id": {"id": "native-id", "type": "native"}
  }
}"""


def test_replacement_manifest_document(spark):
    from ranktide.sources import replacements as RP

    docs = spark.createDataFrame([("preferred.json", "perf", MANIFEST)], "manifest string, axis string, text string")
    mp, rp = RP.explode_manifest_doc(docs)
    idx = LN.src_manifest_line_index(LN.to_lines(docs, ["manifest"]), ["manifest"])
    assert {(r.key, r.line) for r in idx.collect()} == {("is-number", 3), ("other", 7), ("is-nan", 8)}
    out = {r.from_purl: r for r in RP.src_replacement_manifests(mp, rp, idx).collect()}
    assert set(out) == {"pkg:npm/is-number", "pkg:npm/is-nan"}  # "other" has neither target nor native id
    a, b = out["pkg:npm/is-number"], out["pkg:npm/is-nan"]
    assert (a.to_purls, a.axis, a.effort, a.manifest_line) == (["pkg:npm/better-num"], "perf", "minor-migration", 3)
    assert (b.to_purls, b.effort, b.manifest_line) == (["pkg:npm/<native>"], "drop-in", 8)
    assert b.evidence.citation_url.endswith("preferred.json#L8") and a.id == "e18e:preferred.json:is-number"


LOCKS = {
    "four": "importers:\n    .:\n        dependencies:\n            a: 1\n            'b c':\n                specifier: ^8\n    p/x:\n        devDependencies: {c: 1.0, \"d:e\": {v: 2}, bare}\n",
    "mixed": "a: [1, {b: c}]\nimporters:\n  \".\":\n   dependencies:  # own indent\n       '@s/a': {specifier: ^1, version: 1.0.0(react@18)}\n  p/x: {devDependencies: {b: 1,\n    # a comment\n    c: 'it''s'}}\n",
    "flow": "{lockfileVersion: '9', importers: {.: {dependencies: {a: {specifier: 1}, b: [x, y]}}, p: {optionalDependencies: {o: 1}, other: {z: 1}}}}",
    "json": '{"importers": {".": {"dependencies": {"a":1,"b":{"k":[1,2]}}}}}',
    "scalars": "note: |\n  importers:\n   .: x\nimporters:\n  .:\n    dependencies:\n      a: >-\n        text: x\n      b: 'over\n        lines: x'\n      c: plain\n        more\n      ? d\n      : 1\r\n",
    "lists": "importers:\n  .:\n    dependencies:\n    - a: 1\n      b: 2\n    devDependencies:\n      k: 1\npackages:\n- x\n- y: 1\n",
    "anchors": "importers:\n  .: &one\n    dependencies: &two\n      a: !!str 1\n      <<: *two\n",
    "empty_section": "importers:\n  .:\n    dependencies: {}\n    devDependencies:\n  p:\n    dependencies:\n      a: 1\n",
    # Not valid:
    "indent": "importers:\n    .:\n        dependencies:\n            a: 1\n      b: 2\n",
    "unclosed": "importers: {a: {dependencies: {b: 1}}\n",
    "mismatch": "importers: {a: {dependencies: {b: 1]}}\n",
    "two_values": "importers:\n  .:\n    dependencies:\n      a: b: c\n",
    "two_documents": "importers:\n  .:\n    dependencies:\n      a: 1\n---\nx: 1\n",
    "tab": "importers:\n\t.:\n\t\tdependencies: {a: 1}\n",
    "open_quote": "importers:\n  .:\n    dependencies:\n      a: 'x\n",
    # No lockfile:
    "list": "- importers\n- a: 1\n", "text": "importers", "blank": "", "other": "importers: 1\n",
}


def test_lockfiles_in_any_style(spark):
    f = _files(spark, [(k, "pnpm-lock.yaml", 200, v) for k, v in LOCKS.items()] + [("none", "pnpm-lock.yaml", 200, None)])
    got = {}
    for r in MF.lockfile_importers(f).collect():
        got.setdefault(r.repo_url, []).append((r.workspace, r.section[0], r.dep, r.line_no))
    assert got == {
        "four": [(".", "d", "a", 4), (".", "d", "b c", 5), ("p/x", "d", "c", 8), ("p/x", "d", "d:e", 8), ("p/x", "d", "bare", 8)],
        "mixed": [(".", "d", "@s/a", 5), ("p/x", "d", "b", 6), ("p/x", "d", "c", 8)],
        "flow": [(".", "d", "a", 1), (".", "d", "b", 1), ("p", "o", "o", 1)],
        "json": [(".", "d", "a", 1), (".", "d", "b", 1)],
        "scalars": [(".", "d", "a", 7), (".", "d", "b", 9), (".", "d", "c", 11), (".", "d", "d", 13)],
        "lists": [(".", "d", "k", 7)],
        "anchors": [(".", "d", "a", 4)],
        "empty_section": [("p", "d", "a", 7)],
    }
    # A broken lockfile leaves a monorepo's dependencies unknown.
    mono = json.dumps({"workspaces": ["a"]})
    both = f.unionByName(_files(spark, [(k, "package.json", 200, mono) for k in LOCKS]))
    verdicts, names = MF.man_direct_deps(both)
    assert {r.repo_url for r in verdicts.collect() if r.verdict == "set"} == set(got)
    assert {r.name for r in names.collect() if r.repo_url == "mixed"} == {"@s/a", "b", "c"}


def test_lockfile_chunks_change_nothing(spark):
    from ranktide.operators.yaml_keys import yaml_keys

    f = _files(spark, [(k, "p", 200, v) for k, v in LOCKS.items()])
    pick = lambda keys, line: F.struct(F.array_join(keys, "/", "?").alias("k"), line.alias("n"))
    out = f.select(*[yaml_keys(F.col("text"), "struct<k:string,n:int>", pick, chunk).alias(f"c{chunk}") for chunk in (1, 3, 256)])
    assert all(r["c1"] == r["c3"] == r["c256"] for r in out.collect())


def test_a_giant_manifest_is_folded_in_its_row(spark):
    n = 20_000
    text = '{\n  "dependencies": {\n' + ",\n".join(f'    "p{i % 15_000}": "1"' for i in range(n)) + "\n  }\n}"
    f = _files(spark, [("r", "package.json", 200, text)])
    out = MF.man_dep_lines(f)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["name"]: r["line"] for r in out.collect()}
    assert got == {f"p{i}": i + 3 for i in range(15_000)}


def test_one_scan_and_one_exchange_make_a_repositorys_state(spark, tmp_path):
    rows = [("r", "package.json", 200, PKG), ("r", "yarn.lock", 404, None), ("m", "package.json", 200, json.dumps({"workspaces": ["a"]})),
            ("m", "pnpm-lock.yaml", 200, LOCK), ("x", "yarn.lock", 500, None)]
    _files(spark, rows).write.parquet(str(tmp_path / "files"))
    verdicts, _ = MF.man_direct_deps(spark.read.parquet(str(tmp_path / "files")))
    plan = verdicts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") <= 1 and plan.count("FileScan") == 1 and "Join" not in plan
    assert {r.repo_url: r.verdict for r in verdicts.collect()} == {"r": "set", "m": "set", "x": "unknown"}


def test_first_of_each(spark):
    from ranktide.operators.folds import first_of_each

    items = [("b", 1, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n"), ("b", 2, "q"), (None, 1, "m"), ("a", 1, "w")]
    df = spark.createDataFrame([(items,), ([],), (None,)], "l array<struct<k:string,n:int,v:string>>")
    got = [r[0] for r in df.select(first_of_each(F.col("l"), "k", "n")).collect()]
    assert [x["v"] for x in got[0]] == ["x", "y", "n", "q"] and got[1] == [] and got[2] is None
