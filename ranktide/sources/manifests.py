"""Repository manifests: direct-dependency verdicts, lockfile presence, bench signals, locations.

Input is a landed file table ``(owner, repo, repo_url, path, status, text)``
(HTTP status per fetched path; text only for 200). Files are parsed where they lie;
one aggregate over the table makes a repository's state (``repositories``), from
which verdicts, names, signals and locations are read off. Membership tests ("is
the from-package a direct dependency of this repo?") are joins against an exploded
``(repo_url, name)`` table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.functions.util import let
from ranktide.operators import lines as LN
from ranktide.operators.folds import first_of_each

# Fixed values.
ROOT_LOCKFILES = ("pnpm-lock.yaml", "yarn.lock", "package-lock.json")
BENCH_LIBS = ("tinybench", "mitata", "benchmark", "cronometro")
BENCH_CMD_PATTERNS = (r"(?i)\bvitest\s+[^&|;]*bench", r"(?i)\bjest\s+[^&|;]*bench")
# End of fixed values.

SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies", "scripts")


def _package_schema(*sections: str) -> str:
    """Sections as text first: one that isn't an object of strings is unknown by itself, not the whole file."""
    return "struct<" + ",".join(f"{s}:string" for s in sections) + ",_corrupt_record:string>"


PKG_SCHEMA = _package_schema(*SECTIONS)
#: The sections that name a root package's direct dependencies.
ROOT_SECTIONS = ("dependencies", "devDependencies")
KEYS = ["repo_url"]


def by_repository(files: DataFrame) -> DataFrame:
    """The file table with ``repo_url`` spelled from owner and repo, as ``canonical_repo`` does."""
    return files.withColumn("repo_url", F.concat(F.lit("https://github.com/"), F.col("owner"), F.lit("/"), F.col("repo")))


PACKAGE, LOCKFILE = "package.json", "pnpm-lock.yaml"


def _is_object(text: Column, raw: Column) -> Column:
    return raw["_corrupt_record"].isNull() & text.rlike(r"\A[ \t\r\n]*\{")


def _package(text: Column, sections: Sequence[str] = SECTIONS) -> Column:
    """A ``package.json``'s parsed ``sections`` and whether it is a monorepo's; null if it is no JSON object.

    Malformed text lands in the corrupt-record column. Duplicate keys are accepted
    with the last value winning (VARIANT parsing would reject them).
    """
    ws_list = F.from_json(F.get_json_object(text, "$.workspaces"), "array<string>")
    ws_pkgs = F.from_json(F.get_json_object(text, "$.workspaces.packages"), "array<string>")
    named = text.contains("workspaces") | text.contains("\\u")  # no such key, written out or escaped: no need to look for it
    mono = named & (F.coalesce(F.size(ws_list) > 0, F.lit(False)) | F.coalesce(F.size(ws_pkgs) > 0, F.lit(False)))

    def parsed(raw: Column) -> Column:
        parts = [F.from_json(raw[s], "map<string,string>").alias(s) for s in sections]
        return F.when(_is_object(text, raw), F.struct(F.struct(*parts).alias("pkg"), mono.alias("is_monorepo")))

    return let(F.from_json(text, PKG_SCHEMA), parsed)


def repositories(files: DataFrame, locations: bool = False, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """One row per repository: status and ok (of ``package.json``; a null status: not fetched), pkg (its ``sections``),
    is_monorepo (null if no object), has_root_lockfile (some / none and all definitely absent / NULL), importers (rows of
    the lockfile's importers mapping) and, with ``locations``, dep_lines.

    One scan and one exchange; texts are parsed before it and don't move.
    """
    path, status = F.col("path"), F.col("status")
    served = (status == 200) & F.col("text").isNotNull()
    pkg, lock, root = path == PACKAGE, path == LOCKFILE, path.isin(*ROOT_LOCKFILES)
    parsed = [
        F.when(pkg & served, _package(F.col("text"), sections)).alias("found"),
        F.when(lock & served, LN.lockfile_keys(F.col("text"))).alias("importers"),
    ]
    firsts = ["importers"]
    if locations:
        parsed.append(F.when(pkg & served, LN.declared_lines(F.col("text"))).alias("dep_lines"))
        firsts.append("dep_lines")
    rows = files.select(
        "repo_url", F.when(pkg, F.coalesce(status, F.lit(0))).alias("status"), *parsed,
        (root & (status == 200)).alias("__present"), (root & ~status.isin(200, 404)).alias("__unclear"), root.alias("__root"),
    )
    state = rows.groupBy("repo_url").agg(
        F.max("status").alias("status"), F.first("found", ignorenulls=True).alias("found"),
        *[F.first(c, ignorenulls=True).alias(c) for c in firsts],
        F.bool_or("__present").alias("__present"), F.bool_or("__unclear").alias("__unclear"), F.bool_or("__root").alias("__root"),
    )
    lockfile = F.when(F.col("__present"), F.lit(True)).when(F.col("__root") & ~F.col("__unclear"), F.lit(False))
    return state.select(
        "repo_url", "status", F.col("found").isNotNull().alias("ok"), "found.pkg", "found.is_monorepo",
        lockfile.alias("has_root_lockfile"), F.col("__root").alias("probed"), *firsts,
    )


def man_root_lockfile(files: DataFrame) -> DataFrame:
    """Per repo: any root lockfile present -> true; none and all definitive 404 -> false; else NULL."""
    f = files.where(F.col("path").isin(*ROOT_LOCKFILES))
    g = f.groupBy("repo_url").agg(
        F.bool_or(F.col("status") == 200).alias("__any"),
        F.bool_or(~F.col("status").isin(200, 404)).alias("__unknown"),
    )
    return g.select("repo_url", F.when(F.col("__any"), F.lit(True)).when(F.col("__unknown"), F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("has_root_lockfile"))


def man_is_monorepo(files: DataFrame) -> DataFrame:
    return repositories(files).where("ok").select("repo_url", "is_monorepo")


def lockfile_importers(files: DataFrame) -> DataFrame:
    """(repo_url, workspace, section, dep, line_no) from each fetched pnpm lockfile."""
    lf = files.where((F.col("path") == LOCKFILE) & (F.col("status") == 200) & F.col("text").isNotNull())
    return LN.man_lockfile_importers(lf, KEYS)


def _root_names() -> Column:
    return F.array_union(
        F.coalesce(F.map_keys("pkg.dependencies"), F.array().cast("array<string>")),
        F.coalesce(F.map_keys("pkg.devDependencies"), F.array().cast("array<string>")),
    )


def set_union_dep_names(repos: DataFrame) -> DataFrame:
    """Distinct runtime + dev dependency names per repository with a parsed ``package.json``: (repo_url, name)."""
    return repos.where("ok").select("repo_url", F.explode(_root_names()).alias("name"))


def _direct_names() -> Column:
    """The distinct names that count as direct: a monorepo's are its lockfile importers' (null: unknown), others' the two root sections'."""
    single = ~F.coalesce(F.col("is_monorepo"), F.lit(False))
    return F.when(F.col("ok"), F.when(single, _root_names()).otherwise(F.array_distinct(F.transform("importers", lambda x: x["dep"]))))


def _verdict() -> Column:
    return (
        F.when(F.col("status").isNull(), F.lit("unknown"))
        .when(F.col("status") == 404, F.when(F.col("has_root_lockfile") == False, F.lit("not_js")).otherwise(F.lit("unknown")))  # noqa: E712
        .when(~F.col("ok"), F.lit("unknown"))
        .when(F.col("is_monorepo"), F.when(F.coalesce(F.size("importers") > 0, F.lit(False)), F.lit("set")).otherwise(F.lit("monorepo")))
        .otherwise(F.lit("set"))
    )


def direct_deps(files: DataFrame) -> DataFrame:
    """One row per repository: (repo_url, verdict, is_monorepo, names) with the verdict in unknown / not_js / monorepo / set
    and the direct dependency names as an array; one pass over the files."""
    return repositories(files, sections=ROOT_SECTIONS).select("repo_url", _verdict().alias("verdict"), "is_monorepo", _direct_names().alias("names"))


def man_direct_deps(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, names), of ``direct_deps``.

    verdicts: (repo_url, verdict) with verdict in unknown / not_js / monorepo / set.
    names: (repo_url, name) direct dependency names for verdict 'set' repos
    (lockfile importers for monorepos with a lockfile, else the two root sections).
    """
    deps = direct_deps(files)
    return deps.select("repo_url", "verdict", "is_monorepo"), deps.select("repo_url", F.explode("names").alias("name"))


def _bench_signal(raw: Column) -> Column:
    """The first rule that matches sections given as JSON text. A section is parsed if it has a rule's word, as it is or
    perhaps behind an escape."""

    def parsed(section: str, *words: str) -> Column:
        text = F.lower(raw[section])
        may = text.contains("\\")
        for word in words:
            may = may | text.contains(word)
        return F.when(may, F.from_json(raw[section], "map<string,string>"))

    def of_scripts(scripts: Column) -> Column:
        by_name = F.get(F.filter(F.map_keys(scripts), lambda k: F.lower(k).contains("bench")), 0)
        by_cmd = F.get(
            F.filter(F.map_entries(scripts), lambda e: e["value"].rlike(BENCH_CMD_PATTERNS[0]) | e["value"].rlike(BENCH_CMD_PATTERNS[1])), 0
        )["key"]
        return F.coalesce(F.concat(F.lit("script:"), by_name), F.concat(F.lit("script-cmd:"), by_cmd))

    def of_libs(names: Column) -> Column:
        return F.coalesce(*[F.when(F.map_contains_key(names, lib), F.lit(f"devDep:{lib}")) for lib in BENCH_LIBS])

    libs = [let(parsed(field, *BENCH_LIBS), of_libs) for field in ("devDependencies", "dependencies")]
    return F.coalesce(let(parsed("scripts", "bench"), of_scripts), *libs)


def man_bench_signal(files: DataFrame) -> DataFrame:
    """(repo_url, has_benchmarks, bench_signal); first rule that matches wins, unreachable -> (false, NULL).

    A file's signal is found where it lies: that alone is sorted and exchanged by repository.
    """
    text = F.col("text")
    served = (F.col("path") == PACKAGE) & (F.col("status") == 200) & text.isNotNull()

    def signal(raw: Column) -> Column:
        return F.when(_is_object(text, raw), F.struct(_bench_signal(raw).alias("signal")))

    rows = files.select("repo_url", F.when(served, let(F.from_json(text, _package_schema("scripts", *ROOT_SECTIONS)), signal)).alias("found"))
    first = rows.groupBy("repo_url").agg(F.first("found", ignorenulls=True).alias("found"))
    out = first.select("repo_url", F.col("found.signal").alias("bench_signal"))
    return out.select("repo_url", F.col("bench_signal").isNotNull().alias("has_benchmarks"), "bench_signal")


def man_dep_lines(files: DataFrame) -> DataFrame:
    """(repo_url, name, line) of every dependency declared in a root ``package.json``."""
    p = files.where((F.col("path") == "package.json") & (F.col("status") == 200) & F.col("text").isNotNull())
    return LN.man_dep_lines(p, KEYS)


def man_dep_locations(requests: DataFrame | None, files: DataFrame) -> DataFrame:
    """(repo_url, name) requests -> (repo_url, name, locations ARRAY<STRUCT<file,line>>).

    Monorepos: one location per workspace file declaring the dep (line NULL;
    '' or '.' -> the root file; distinct per file, first seen first). Single
    packages: the root ``package.json`` line. Unreachable or unparseable
    manifests and names not found give no row. ``None``: each repository's direct
    dependencies (``direct_deps``) are asked for; these lie in its own row, so that needs no join.
    """
    ws_file = lambda w: F.when(w.isin("", "."), F.lit(PACKAGE)).otherwise(
        F.concat(F.regexp_replace(w, "/+$", ""), F.lit(f"/{PACKAGE}"))
    )
    place = lambda name, file, line, pos: F.struct(
        name.alias("name"), F.struct(file.alias("file"), line.alias("line")).alias("loc"), pos.alias("pos")
    )
    mono = F.transform("importers", lambda x: place(x["dep"], ws_file(x["workspace"]), F.lit(None).cast("int"), x["line_no"]))
    single = F.transform("dep_lines", lambda x: place(x["name"], F.lit(PACKAGE), x["line_no"], x["line_no"]))
    repos = repositories(files, locations=True, sections=ROOT_SECTIONS).where("ok")
    declared = first_of_each(F.when(F.col("is_monorepo"), mono).otherwise(single), "name", "loc")
    if requests is None:
        named = repos.select("repo_url", declared.alias("declared"), _direct_names().alias("names")).where(F.col("repo_url").isNotNull())
        found = named.select("repo_url", "names", F.inline_outer("declared")).where(F.array_contains("names", F.col("name")))
    else:
        found = requests.join(repos.select("repo_url", F.inline_outer(declared)), ["repo_url", "name"])
    g = found.groupBy("repo_url", "name").agg(F.sort_array(F.collect_list(F.struct("pos", "loc"))).alias("__l"))
    return g.select("repo_url", "name", F.transform("__l", lambda x: x["loc"]).alias("locations"))
