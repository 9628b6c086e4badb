"""Domain tables derived from the shared TPC-H-like test tables.

The engine's inputs are landed snapshots (advisories, projects, transitions,
dependents, replacements, registry documents, repository manifests). The test
harness ships TPC-H-like tables instead, so each domain table here is a pure
DataFrame derivation of them. The same derivations exist as DuckDB SQL in
``ranktide.catalog.oracle`` so every registered query can be checked against
an independent engine. All derivations are row-local projections or
aggregations keyed by the natural key, so they scale with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def part_purl(key) -> Column:
    return F.concat(F.lit("pkg:npm/part-"), _s(key))


def part_repo(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("https://github.com/org"), _s(k % 97), F.lit("/part-"), _s(k))


def by_part(line_items: DataFrame) -> DataFrame:
    """Line items brought together by part: what is grouped by it and more, and then joined to ``parts``, needs no other exchange."""
    return line_items.repartition("l_partkey")


def parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Parts to be joined by key where they lie. A broadcast is decided by the size of a column's share of the file, which
    can be a twentieth of the hashed rows that the driver has to hold."""
    return read(spark, sf_dir, "part").select("p_partkey", *columns).hint("shuffle_hash")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project snapshot per (part, ship year); ingest date = Dec 31 of that year."""
    li = by_part(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    pa = parts(spark, sf_dir, "p_retailprice")
    g = (
        li.withColumn("y", F.year("l_shipdate"))
        .groupBy("l_partkey", "y")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.count_distinct("l_suppkey").alias("nsupp"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )
    p = F.col("p_partkey")
    return g.join(pa, g.l_partkey == pa.p_partkey).select(
        part_purl("p_partkey").alias("purl"),
        F.lit("npm").alias("ecosystem"),
        F.concat(F.lit("part-"), _s(p)).alias("name"),
        part_repo("p_partkey").alias("repo_url"),
        F.lit(None).cast("string").alias("homepage"),
        F.floor("p_retailprice").cast("bigint").alias("stars"),
        F.when(p % 17 == 0, F.lit(None)).otherwise((F.col("qty") * 1000).cast("bigint")).cast("bigint").alias("downloads_weekly"),
        F.col("nsupp").cast("bigint").alias("dependents"),
        F.col("first_ship").alias("last_release_at"),
        F.col("last_ship").alias("last_commit_at"),
        F.when(p % 19 == 0, F.lit(None)).otherwise(F.col("last_ship")).alias("last_pr_merged_at"),
        ((p + F.col("y")) % 10 == 0).alias("archived"),
        F.when(p % 3 == 0, F.lit(True)).when(p % 3 == 1, F.lit(False)).otherwise(F.lit(None).cast("boolean")).alias("has_benchmarks"),
        F.when(p % 3 == 0, F.lit("devDep:tinybench")).otherwise(F.lit(None).cast("string")).alias("bench_signal"),
        F.make_date(F.col("y"), F.lit(12), F.lit(31)).alias("ingest_date"),
    )


def _fix_version(n: Column) -> Column:
    return (
        F.when(n % 3 == 0, F.concat(F.lit("v"), _s(n), F.lit(".1.0")))
        .when(n % 3 == 1, F.concat(_s(n), F.lit(".2.3")))
        .otherwise(F.concat(F.lit("next-"), _s(n)))
    )


def _affected_range(p: Column, n: Column, size: Column) -> Column:
    """Six range shapes: upper bound, closed interval, <=, =, unparseable, none."""
    return (
        F.when(p % 6 == 0, F.concat(F.lit("< "), _s(size + n - 3), F.lit(".0.0")))
        .when(p % 6 == 1, F.concat(F.lit(">= 1.0.0, < "), _s(size), F.lit("."), _s(n), F.lit(".0")))
        .when(p % 6 == 2, F.concat(F.lit("<= "), _s(size - 4), F.lit("."), _s(n)))
        .when(p % 6 == 3, F.concat(F.lit(">= "), _s(size), F.lit(".0.0, <= "), _s(size + 1), F.lit(".0.0,")))
        .when(p % 6 == 4, F.concat(F.lit("~> 1."), _s(n)))
        .otherwise(F.lit(None).cast("string"))
    )


def _greatest_is(col: str, value: str) -> list[Column]:
    """Whether a group's greatest value is this one, as two booleans: unlike a string's maximum these are hash aggregates,
    so no group is sorted."""
    return [F.bool_or(F.col(col) == value).alias(f"has_{value}"), F.bool_or(F.col(col) > value).alias(f"past_{value}")]


def _least_is(col: str, value: str) -> list[Column]:
    return [F.bool_or(F.col(col) == value).alias(f"has_{value}"), F.bool_or(F.col(col) < value).alias(f"past_{value}")]


def advisory_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a landed advisory says, before it is spelled (``advisory_columns``): one row per (part, line number, ship date)."""
    li = by_part(read(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_linenumber", "l_shipdate", "l_discount", "l_returnflag", "l_linestatus"
    ))
    pa = parts(spark, sf_dir, "p_size")
    g = li.groupBy("l_partkey", "l_linenumber", "l_shipdate").agg(
        F.max("l_discount").alias("disc"),
        *_greatest_is("l_returnflag", "R"), *_least_is("l_returnflag", "A"), *_least_is("l_linestatus", "F"),
    )
    g = g.join(pa, g.l_partkey == pa.p_partkey)
    is_extreme = lambda v: (F.col(f"has_{v}") & ~F.col(f"past_{v}")).alias(f"is_{v}")
    return g.select(
        "l_partkey", "l_linenumber", "l_shipdate", "disc", *map(is_extreme, "RFA"), "p_size",
        F.col("l_shipdate").cast("date").alias("ingest_date"),
    )


def advisory_columns() -> list[Column]:
    """The columns of a landed advisory, of those of ``advisory_keys``."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    adv_id = F.concat(F.lit("ADV-"), _s(p), F.lit("-"), _s(n))
    return [
        adv_id.alias("id"),
        part_purl("l_partkey").alias("project_purl"),
        F.when(F.col("disc") >= 0.08, "critical").when(F.col("disc") >= 0.04, "high").otherwise("medium").alias("severity"),
        F.when(F.col("is_R"), F.lit(None)).otherwise(F.col("disc") * F.lit(100.0)).cast("double").alias("cvss"),
        F.when(F.col("is_F"), F.concat(F.lit("Breaking change required in part-"), _s(p)))
        .otherwise(F.concat(F.lit("Prototype pollution in part-"), _s(p)))
        .alias("summary"),
        _affected_range(p, n, F.col("p_size")).alias("affected_versions"),
        F.when(F.col("is_A"), F.array(_fix_version(n))).otherwise(F.array().cast("array<string>")).alias("fixed_versions"),
        F.array(F.concat(F.lit("https://example.org/advisories/"), adv_id)).alias("refs"),
        F.col("l_shipdate").alias("published_at"),
        part_repo("l_partkey").alias("repo_url"),
        F.col("ingest_date"),
    ]


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed advisories: one per (part, line number, ship date); grain (id, ingest_date)."""
    return advisory_keys(spark, sf_dir).select(*advisory_columns())


STATE_BY_EVENT = {"view": "new", "signup": "acknowledged", "click": "resolved", "error": "rejected", "purchase": "duplicate"}


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only transition log from the events table."""
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    u = F.col("user_id")
    state = F.lit("duplicate")
    for k, v in reversed(list(STATE_BY_EVENT.items())):
        state = F.when(F.col("event_type") == k, F.lit(v)).otherwise(state)
    return ev.select(
        F.concat(part_purl(u), F.lit("|ADV-"), _s(u), F.lit("-"), _s(F.lit(1) + F.col("event_id") % 7)).alias("dedupe_key"),
        state.alias("to_state"),
        F.col("ts").alias("transitioned_at"),
        F.concat(F.lit("user-"), _s(u)).alias("actor"),
        F.concat(F.col("event_type"), F.lit(":"), _s("event_id")).alias("reason"),
        F.col("ts").cast("date").alias("ingest_date"),
    )


def sbom_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SBOM-style edges (primary dependents source): package part -> dependent repo.

    Only non-SMALL part families are indexed by this source, so the fallback
    tier is exercised for the rest. Edges are made distinct as keys, before names are
    spelled: a name says no more than its keys.
    """
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    small = F.coalesce(F.col("p_type") == "SMALL", F.lit(False))
    pa = read(spark, sf_dir, "part").select("p_partkey", small.alias("small")).distinct()
    su = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").distinct()
    e = li.join(pa, li.l_partkey == pa.p_partkey).join(su, li.l_suppkey == su.s_suppkey)
    return e.select(
        F.when(F.col("small"), "PYPI").otherwise("NPM").alias("package_artifact_source"),
        F.concat(F.lit("part-"), _s("l_partkey")).alias("package_artifact_name"),
        F.lit("GITHUB").alias("dependent_artifact_source"),
        F.concat(F.lit("repo-"), _s("s_suppkey")).alias("dependent_artifact_id"),
        F.concat(F.lit("nation"), _s("s_nationkey")).alias("dependent_artifact_namespace"),
        F.concat(F.lit("supp-"), _s("s_suppkey")).alias("dependent_artifact_name"),
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    su = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return su.select(
        F.concat(F.lit("repo-"), _s("s_suppkey")).alias("artifact_id"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://github.com/nation"), _s("s_nationkey"), F.lit("/supp-"), _s("s_suppkey")))
        .alias("artifact_url"),
        F.floor(F.col("s_acctbal") / 10).cast("bigint").alias("star_count"),
    )


def registry_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry-style dependents (fallback source): package part -> dependent order package."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    g = li.groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"))
    o = F.col("l_orderkey")
    return g.select(
        F.concat(F.lit("part-"), _s("l_partkey")).alias("package"),
        F.when(o % 13 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("order-"), _s(o))).alias("name"),
        F.when(o % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://github.com/cust/order-"), _s(o),
                            F.when(o % 4 == 1, F.lit(".git")).when(o % 4 == 2, F.lit("/")).otherwise(F.lit(""))))
        .alias("repository_url"),
        F.col("q").cast("bigint").alias("downloads"),
    )


def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed replacement rows: several manifests may map the same from-package."""
    pa = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    manifest = F.when(k % 3 == 0, "preferred.json").when(k % 3 == 1, "native.json").otherwise("micro-utilities.json")
    band = (
        F.when(s % 4 == 0, "drop-in").when(s % 4 == 1, "minor-migration")
        .when(s % 4 == 2, "codemod-available").otherwise("rewrite")
    )
    from_name = F.concat(F.lit("part-"), _s(k % 500))
    return pa.select(
        F.concat(F.lit("e18e:"), manifest, F.lit(":"), from_name, F.lit("#"), _s(k)).alias("id"),
        F.concat(F.lit("pkg:npm/"), from_name).alias("from_purl"),
        F.when(s % 4 == 0, F.array(F.lit("pkg:npm/<native>")))
        .otherwise(F.array(F.concat(F.lit("pkg:npm/alt-"), _s(k)))).alias("to_purls"),
        F.when(k % 3 == 0, "perf").otherwise("bloat").alias("axis"),
        band.alias("effort"),
        manifest.alias("manifest"),
        (s * 3 + 2).cast("bigint").alias("manifest_line"),
        k.cast("bigint").alias("seq"),
    )


def registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry JSON document per package with a ``dist-tags.latest`` version."""
    pa = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    base = F.concat(_s(s), F.lit("."), _s(k % 10), F.lit("."), _s(k % 3))
    ver = (
        F.when(k % 7 == 0, F.concat(F.lit("v"), base))
        .when(k % 7 == 1, F.concat(base, F.lit("-beta.1")))
        .when(k % 7 == 2, F.lit("latest-build"))
        .when(k % 7 == 3, F.lit(""))
        .otherwise(base)
    )
    doc = F.concat(
        F.lit('{"name": "part-'), _s(k), F.lit('", "dist-tags": {"latest": "'), ver, F.lit('", "next": "99.0.0"}}')
    )
    return pa.select(F.concat(F.lit("part-"), _s(k)).alias("name"), doc.alias("doc"))


def nested_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory documents (REST shape): one per order, its line items as affected packages.

    The per-order ``collect_list`` is bounded by the line items of one order. It holds
    numbers in the order of the finished packages: only whole documents are spelled.
    """
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"
    ).where(F.col("l_orderkey").isNotNull())
    od = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    flag = F.col("l_returnflag")
    item = F.struct(
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.when(F.col("l_linestatus") == "F", 0).when(flag == "N", 2).otherwise(1).cast("tinyint").alias("eco"),  # as NPM, npm, pip sort
        F.coalesce(flag == "A", F.lit(False)).alias("patched"),
    )
    items = li.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"), F.min("l_partkey").alias("min_part"))
    # An order that stands there several times has its line items as often.
    od = od.repartition("o_orderkey").groupBy("o_orderkey", "o_orderdate", "o_orderpriority").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    copies = F.col("copies")

    def vuln(x: Column) -> Column:
        return F.struct(
            F.struct(
                F.when(x["eco"] == 0, "NPM").when(x["eco"] == 2, "pip").otherwise("npm").alias("ecosystem"),
                F.when(x["sk"] % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("part-"), _s(x["pk"]))).alias("name"),
            ).alias("package"),
            F.concat(F.lit("< "), _s(x["pos"]), F.lit(".0.0")).alias("vulnerable_version_range"),
            F.when(x["patched"], F.concat(_s(x["pos"]), F.lit(".0.1"))).alias("first_patched_version"),
        )

    each = F.when(copies == 1, F.col("items")).otherwise(F.flatten(F.transform("items", lambda x: F.array_repeat(x, copies))))
    g = items.join(od, items.l_orderkey == od.o_orderkey)
    o = F.col("o_orderkey")
    sev = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "MEDIUM")
        .otherwise("low")
    )
    return g.select(
        F.concat(F.lit("GHSA-"), _s(o)).alias("ghsa_id"),
        F.when(o % 9 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Issue in order "), _s(o))).alias("summary"),
        sev.alias("severity"),
        F.when(o % 11 == 0, F.lit("2001-01-01T00:00:00Z")).alias("withdrawn_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.when(o % 4 == 0, F.lit("")).otherwise(part_repo(F.col("min_part"))).alias("source_code_location"),
        F.array(F.concat(F.lit("https://example.org/GHSA-"), _s(o))).alias("references"),
        F.struct(F.when(o % 5 == 0, F.lit(None).cast("double")).otherwise((o % 100).cast("double") / 10.0).alias("score")).alias("cvss"),
        F.struct(
            F.struct(F.when(o % 3 == 0, F.lit(None).cast("double")).otherwise((o % 90).cast("double") / 10.0).alias("score")).alias("cvss_v3"),
            F.struct(F.when(o % 2 == 0, F.lit(0.0)).otherwise((o % 70).cast("double") / 10.0).alias("score")).alias("cvss_v4"),
        ).alias("cvss_severities"),
        F.transform(F.sort_array(each), vuln).alias("vulnerabilities"),
        o.alias("page_pos"),
    )


def repo_meta_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository metadata responses (GraphQL shape) per part repository; some are errors."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    pa = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    g = li.groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_ship"))
    j = g.join(pa, g.l_partkey == pa.p_partkey)
    p = F.col("p_partkey")
    node = F.when(p % 19 == 0, F.lit("")).otherwise(
        F.concat(F.lit('{"mergedAt": "'), F.date_format("last_ship", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}'))
    )
    ok_doc = F.concat(
        F.lit('{"data": {"repository": {"isArchived": '),
        F.when(F.col("p_size") % 10 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "defaultBranchRef": {"target": {"oid": "sha'), _s(p),
        F.lit('"}}, "pullRequests": {"nodes": ['), node, F.lit("]}}}}"),
    )
    doc = F.when(p % 23 == 0, F.lit('{"errors": [{"message": "rate limited"}]}')).otherwise(ok_doc)
    return j.select(part_repo("p_partkey").alias("repo_url"), doc.alias("doc"))


def dependents_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly dependents cache rows from events: key (system, name, ISO week).

    Payload = the week's purchase events of a user, best five by value (an empty
    list when the user made none that week: still a cache hit). The top-5 is
    taken with a ranking window before ``collect_list``, so no group is unbounded.
    """
    from ranktide.functions.dates import iso_week
    from ranktide.operators.windows import top_k_per_group

    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumn("wk", iso_week("ts"))
    top = top_k_per_group(
        ev, ["user_id", "wk"],
        [(F.col("event_type") == "purchase").desc(), F.col("value").desc(), F.col("event_id").asc()], 5, rank_col="rn",
    )
    e = F.col("event_id")
    item = F.struct(
        F.col("rn"),
        F.concat(F.lit("evt-"), _s(e)).alias("name"),
        F.concat(F.lit("pkg:npm/evt-"), _s(e)).alias("purl"),
        F.when(e % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("https://github.com/evt/evt-"), _s(e))).alias("repo_url"),
        F.floor("value").cast("bigint").alias("lifetime_downloads"),
    )
    g = top.groupBy("user_id", "wk").agg(
        F.sort_array(F.collect_list(F.when(F.col("event_type") == "purchase", item))).alias("p"),
        F.max("ts").alias("written_at"),
    )
    return g.select(
        F.lit("npm").alias("system"),
        F.concat(F.lit("part-"), _s("user_id")).alias("name"),
        F.col("wk").alias("iso_week"),
        F.transform("p", lambda x: x.dropFields("rn")).alias("payload"),
        F.col("written_at"),
    )


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed repository files per order repo: (owner, repo, repo_url, path, status, text).

    ``package.json`` lists the order's line items as dependencies (odd line
    numbers runtime, even dev); returned ('R') items are left out (transitive
    only). Some repos are monorepos with a ``pnpm-lock.yaml`` (importers in block
    style of two indents, quoted with flow values, or all in flow style; some broken),
    some answer 404 / 500, some hold malformed or non-object JSON. The three
    root lockfiles are probed with HEAD-style statuses. Per-order collects are
    bounded by the line items of one order.
    """
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    is_listed = F.coalesce(F.col("l_returnflag") != "R", F.lit(False)).alias("listed")
    g = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", is_listed)).alias("items"))
    g = g.withColumn("items", F.sort_array("items"))
    o = F.col("l_orderkey")
    listed = F.filter("items", lambda x: x["listed"])
    runtime = F.filter(listed, lambda x: x["l_linenumber"] % 2 == 1)
    dev = F.filter(listed, lambda x: x["l_linenumber"] % 2 == 0)

    def dep_lines(arr, extra=None):
        body = F.transform(arr, lambda x: F.concat(F.lit('    "part-'), x["l_partkey"].cast("string"), F.lit('": "^'), x["l_linenumber"].cast("string"), F.lit('.0.0"')))
        if extra is not None:
            body = F.concat(body, extra)
        return F.array_join(body, ",\n")

    tiny = F.when(o % 11 == 0, F.array(F.lit('    "tinybench": "^2.0.0"'))).otherwise(F.array().cast("array<string>"))
    first_part = F.get(F.col("items"), 0)["l_partkey"].cast("string")
    script2 = (
        F.when(o % 5 == 0, F.lit('    "bench:run": "node bench.js"'))
        .when(o % 7 == 0, F.lit('    "ci": "vitest run && bench-report"'))
        .when(o % 7 == 1, F.lit('    "test:perf": "vitest bench src/"'))
        .otherwise(F.lit('    "test": "jest"'))
    )
    monorepo = o % 13 == 0
    pkg = F.concat_ws(
        "\n",
        F.when(o % 31 == 0, F.lit("")),  # a line end before the object
        F.lit("{"),
        F.concat(F.lit('  "name": "order-'), o.cast("string"), F.lit('",')),
        F.lit('  "version": "1.0.0",'),
        F.when(o % 2 == 0, F.concat(F.lit('  "overrides": {\n    "part-'), first_part, F.lit('": "1.0.0"\n  },'))),
        F.when(o % 3 > 0, F.array_join(F.transform(F.sequence(F.lit(1), (o % 3).cast("int")), lambda k: F.concat(F.lit('  "x-pad-'), k.cast("string"), F.lit('": '), k.cast("string"), F.lit(","))), "\n")),
        F.concat(F.lit('  "scripts": {\n    "build": "tsc",\n'), script2, F.lit("\n  },")),
        F.when(monorepo, F.when(o % 2 == 0, F.lit('  "workspaces": {"packages": ["packages/*"]},')).otherwise(F.lit('  "workspaces": ["packages/*"],'))),
        F.concat(F.lit('  "dependencies": {\n'), dep_lines(runtime), F.lit("\n  },")),
        F.concat(F.lit('  "devDependencies": {\n'), dep_lines(dev, tiny), F.lit("\n  }"),
                 F.when(o % 37 == 0, F.lit(',\n  "peerDependencies": []')).otherwise(F.lit(""))),
        F.lit("}"),
    )
    pkg_text = F.when(o % 23 == 0, F.lit("not json {")).when(o % 29 == 0, F.lit("[1, 2]")).otherwise(pkg)
    pkg_status = F.when(o % 17 == 0, F.lit(404)).when(o % 19 == 0, F.lit(500)).otherwise(F.lit(200))

    def importers(step: str, dep) -> Column:
        """The two importers, a section each, in block style with ``step`` as indent."""

        def one(ws: str, section: str, arr) -> Column:
            return F.concat(F.lit(f"{step}{ws}:\n{2 * step}{section}:\n"), F.array_join(F.transform(arr, dep), "\n"))

        return F.concat_ws("\n", one("'.'", "dependencies", runtime), one("packages/app", "devDependencies", dev))

    def blocks(step: str):
        return lambda x: F.concat(
            F.lit(f"{3 * step}part-"), x["l_partkey"].cast("string"), F.lit(f":\n{4 * step}specifier: ^1.0.0\n{4 * step}version: 1.0.0")
        )

    flow_dep = lambda x: F.concat(F.lit("part-"), x["l_partkey"].cast("string"), F.lit(": {specifier: ^1.0.0, version: 1.0.0}"))
    quoted = lambda x: F.concat(F.lit("      'part-"), x["l_partkey"].cast("string"), F.lit("': {\"specifier\": ^1.0.0, version: 1.0.0}  # one"))
    flow = F.concat(
        F.lit("  \".\": {dependencies: {"), F.array_join(F.transform(runtime, flow_dep), ", "),
        F.lit("}}\n  packages/app: {devDependencies: {"), F.array_join(F.transform(dev, flow_dep), ", "), F.lit("}}"),
    )
    style = F.floor(o / 26) % 4
    lock = F.concat_ws(
        "\n",
        F.lit("lockfileVersion: '9.0'"),
        F.lit(""),
        F.lit("importers:"),
        F.lit(""),
        F.when(style == 0, importers("  ", blocks("  "))).when(style == 1, importers("    ", blocks("    ")))
        .when(style == 2, importers("  ", quoted)).otherwise(flow),
        F.lit(""),
        F.lit("packages:"),
        F.concat(F.lit("  part-"), first_part, F.lit("@1.0.0:\n    resolution: {integrity: sha512-x}")),
        F.when(o % 5 == 0, F.lit("   stray: 1")),  # no open mapping has this indent: not valid
    )
    has_lock = monorepo & (o % 26 != 0)
    lock_status = F.when(has_lock | ((o % 17 == 0) & (o % 2 == 0)), F.lit(200)).otherwise(F.lit(404))
    yarn_status = F.when((o % 17 == 0) & (o % 3 == 0), F.lit(503)).otherwise(F.lit(404))
    base = g.select(
        F.lit("cust").alias("owner"),
        F.concat(F.lit("order-"), o.cast("string")).alias("repo"),
        F.concat(F.lit("https://github.com/cust/order-"), o.cast("string")).alias("repo_url"),
        F.array(
            F.struct(F.lit("package.json").alias("path"), pkg_status.alias("status"), F.when(pkg_status == 200, pkg_text).alias("text")),
            F.struct(F.lit("pnpm-lock.yaml").alias("path"), lock_status.alias("status"), F.when(has_lock, lock).alias("text")),
            F.struct(F.lit("yarn.lock").alias("path"), yarn_status.alias("status"), F.lit(None).cast("string").alias("text")),
            F.struct(F.lit("package-lock.json").alias("path"), F.lit(404).alias("status"), F.lit(None).cast("string").alias("text")),
        ).alias("files"),
    )
    return base.select("owner", "repo", "repo_url", F.inline("files"))


# Replacement manifests: file name and the axis recorded for its entries (fixed values).
MANIFESTS = (("preferred.json", "perf"), ("native.json", "bloat"), ("micro-utilities.json", "bloat"))
REPLACEMENT_TYPES = ("documented", "native", "simple", "removal")


def _manifest_of(k: Column) -> tuple[Column, Column]:
    name = F.lit(MANIFESTS[2][0])
    axis = F.lit(MANIFESTS[2][1])
    for i in (1, 0):
        name = F.when(k % 3 == i, F.lit(MANIFESTS[i][0])).otherwise(name)
        axis = F.when(k % 3 == i, F.lit(MANIFESTS[i][1])).otherwise(axis)
    return name, axis


def e18e_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest ``mappings`` entries: (manifest, axis, from_name, ids, k) - one per part."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    g = li.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s1"), F.max("l_suppkey").alias("s2"))
    k = F.col("l_partkey")
    name, axis = _manifest_of(k)
    ids = F.array(F.concat(F.lit("r"), _s("s1")), F.concat(F.lit("r"), _s("s2")))
    ids = F.when(k % 11 == 0, F.concat(ids, F.array(F.concat(F.lit("unknown-"), _s(k))))).otherwise(ids)
    return g.select(name.alias("manifest"), axis.alias("axis"), F.concat(F.lit("part-"), _s(k)).alias("from_name"), ids.alias("ids"), k.alias("k"))


def e18e_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest ``replacements`` entries: (manifest, id, type, replacementModule) per supplier and manifest."""
    su = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = []
    for idx, (m, _axis) in enumerate(MANIFESTS):
        t = F.element_at(F.array(*[F.lit(x) for x in REPLACEMENT_TYPES]), ((F.col("s_nationkey") + idx) % 4 + 1).cast("int"))
        rows.append(su.select(
            F.lit(m).alias("manifest"), F.concat(F.lit("r"), _s("s_suppkey")).alias("id"), t.alias("type"),
            F.when((t == "documented") & (F.col("s_suppkey") % 5 != 0), F.concat(F.lit("mod-"), _s("s_suppkey"))).alias("replacementModule"),
            F.col("s_suppkey"),
        ))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def e18e_manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest files as line tables (manifest, line_no, line), never assembled into one string.

    Layout: ``{`` / ``"mappings": {`` / four lines per mapping (entry r of a
    manifest starts at line 3 + 4r) / ``},`` / ``"replacements": {`` / three
    lines per replacement / closing braces.
    """
    mp = e18e_mappings(spark, sf_dir).withColumn("r", F.floor(F.col("k") / 3))
    n = mp.groupBy("manifest").agg(F.count(F.lit(1)).alias("n"))
    rp = e18e_replacements(spark, sf_dir)
    mins = rp.groupBy("manifest").agg(F.min("s_suppkey").alias("s0"), F.count(F.lit(1)).alias("m"))
    mp = mp.join(n, "manifest")
    base = F.lit(3) + F.col("r") * 4
    ids_json = F.array_join(F.transform("ids", lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ", ")
    entry = F.array(
        F.struct(base.alias("line_no"), F.concat(F.lit('    "'), F.col("from_name"), F.lit('": {')).alias("line")),
        F.struct((base + 1).alias("line_no"), F.lit('      "type": "module",').alias("line")),
        F.struct((base + 2).alias("line_no"), F.concat(F.lit('      "replacements": ['), ids_json, F.lit("]")).alias("line")),
        F.struct((base + 3).alias("line_no"), F.when(F.col("r") == F.col("n") - 1, F.lit("    }")).otherwise(F.lit("    },")).alias("line")),
    )
    e_lines = mp.select("manifest", F.inline(entry))
    rj = rp.join(mins, "manifest").join(n, "manifest")
    j = F.col("s_suppkey") - F.col("s0")
    rb = F.lit(5) + F.col("n") * 4 + j * 3
    r_entry = F.array(
        F.struct(rb.alias("line_no"), F.concat(F.lit('    "'), F.col("id"), F.lit('": {')).alias("line")),
        F.struct((rb + 1).alias("line_no"), F.concat(F.lit('      "type": "'), F.col("type"), F.lit('"')).alias("line")),
        F.struct((rb + 2).alias("line_no"), F.when(j == F.col("m") - 1, F.lit("    }")).otherwise(F.lit("    },")).alias("line")),
    )
    r_lines = rj.select("manifest", F.inline(r_entry))
    frame = n.join(mins, "manifest").select("manifest", F.inline(F.array(
        F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit("{").alias("line")),
        F.struct(F.lit(2).cast("bigint").alias("line_no"), F.lit('  "mappings": {').alias("line")),
        F.struct((F.col("n") * 4 + 3).cast("bigint").alias("line_no"), F.lit("  },").alias("line")),
        F.struct((F.col("n") * 4 + 4).cast("bigint").alias("line_no"), F.lit('  "replacements": {').alias("line")),
        F.struct((F.col("n") * 4 + 5 + F.col("m") * 3).cast("bigint").alias("line_no"), F.lit("  }").alias("line")),
        F.struct((F.col("n") * 4 + 6 + F.col("m") * 3).cast("bigint").alias("line_no"), F.lit("}").alias("line")),
    )))
    cast = lambda d: d.select("manifest", F.col("line_no").cast("bigint").alias("line_no"), "line")
    return cast(frame).unionByName(cast(e_lines)).unionByName(cast(r_lines))
