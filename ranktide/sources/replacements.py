"""Replacement manifests -> one replacement row per (manifest, from-package).

Inputs are the manifests' ``mappings`` entries ``(manifest, axis, from_name,
ids)`` and ``replacements`` entries ``(manifest, id, type,
replacementModule)``; for a whole JSON manifest document use
``explode_manifest_doc``. Resolution is an ``posexplode`` of the ids, a left
join to the replacement entries on (manifest, id) and one aggregation per
mapping (bounded by the ids of one entry).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.functions.strings import MANIFEST_BLOB_BASE
from ranktide.operators.aggregates import BAND_FLOOR, BAND_RANK, band_rank

# Effort band by replacement type; unknown types count as minor-migration.
EFFORT_BY_TYPE = {"native": "drop-in", "documented": "minor-migration", "simple": "codemod-available", "removal": "drop-in"}
EVIDENCE_SOURCE = "e18e"
NATIVE_TARGET = "pkg:npm/<native>"
# End of fixed values.

MAPPINGS_SCHEMA = "map<string,struct<type:string,moduleName:string,replacements:array<string>>>"
REPLACEMENTS_SCHEMA = "map<string,struct<id:string,type:string,replacementModule:string,url:string>>"


def explode_manifest_doc(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, axis, text) JSON documents -> (mappings rows, replacements rows).

    The ``mappings`` / ``replacements`` objects are parsed as MAPs, which keep
    document order; ``posexplode`` turns them into rows.
    """
    p = docs.select(
        "manifest", "axis",
        F.from_json(F.get_json_object("text", "$.mappings"), MAPPINGS_SCHEMA).alias("m"),
        F.from_json(F.get_json_object("text", "$.replacements"), REPLACEMENTS_SCHEMA).alias("r"),
    )
    mp = p.select("manifest", "axis", F.posexplode("m").alias("k", "from_name", "v")).select(
        "manifest", "axis", "from_name", F.coalesce(F.col("v.replacements"), F.array().cast("array<string>")).alias("ids"), "k"
    )
    rp = p.select("manifest", F.explode("r").alias("id", "v")).select("manifest", "id", F.col("v.type").alias("type"), F.col("v.replacementModule").alias("replacementModule"))
    return mp, rp


def resolve_target(type_col: Column, module: Column, rid: Column, known: Column) -> tuple[Column, Column]:
    """id -> (target, type): unknown id is its own documented target; documented -> module or id; others none."""
    rtype = F.when(known, type_col).otherwise(F.lit("documented"))
    target = (
        F.when(~known, rid)
        .when(type_col == "documented", F.coalesce(F.nullif(module, F.lit("")), rid))
    )
    return target, rtype


def src_resolve_target(mappings: DataFrame, replacements: DataFrame) -> DataFrame:
    """One row per (manifest, from_name, id position): resolved target and type."""
    x = mappings.select("manifest", "axis", "from_name", "k", F.posexplode("ids").alias("pos", "rid"))
    r = replacements.select(
        F.col("manifest").alias("__m"), F.col("id").alias("__id"), F.col("type").alias("__type"),
        F.col("replacementModule").alias("__mod"), F.lit(True).alias("__known"),
    )
    j = x.join(r, (x.manifest == r["__m"]) & (x.rid == r["__id"]), "left")
    known = F.coalesce(F.col("__known"), F.lit(False))
    target, rtype = resolve_target(F.col("__type"), F.col("__mod"), F.col("rid"), known)
    band_map = F.create_map(*[x for k, v in EFFORT_BY_TYPE.items() for x in (F.lit(k), F.lit(v))])
    return j.select(
        "manifest", "axis", "from_name", "k", "pos", "rid", target.alias("target"), rtype.alias("type"),
        F.coalesce(band_map[rtype], F.lit(BAND_FLOOR)).alias("band"),
    )


def src_replacement_manifests(mappings: DataFrame, replacements: DataFrame, line_index: DataFrame | None = None) -> DataFrame:
    """Replacement rows: id, from/to purls, axis, easiest band, evidence (with the manifest line)."""
    res = src_resolve_target(mappings, replacements)
    g = res.groupBy("manifest", "axis", "from_name", "k").agg(
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("pos", "target")))).alias("__t"),
        F.max(band_rank("band")).alias("__r"),
        F.bool_or(F.col("type") == "native").alias("__native"),
        F.sort_array(F.collect_list(F.struct("pos", "rid"))).alias("__ids"),
    )
    # Entries with no ids never reach the explode: they have neither target nor native id, so are skipped anyway.
    g = g.where((F.size("__t") > 0) | F.col("__native"))
    names = F.create_map(*[x for k, v in BAND_RANK.items() for x in (F.lit(v), F.lit(k))])
    effort = names[F.greatest(F.col("__r"), F.lit(BAND_RANK[BAND_FLOOR]))]
    if line_index is not None:
        li = line_index.select(F.col("manifest").alias("__lm"), F.col("key").alias("__lk"), F.col("line").alias("manifest_line"))
        g = g.join(li, (g.manifest == li["__lm"]) & (g.from_name == li["__lk"]), "left").drop("__lm", "__lk")
    else:
        g = g.withColumn("manifest_line", F.lit(None).cast("int"))
    targets = F.transform("__t", lambda t: F.concat(F.lit("pkg:npm/"), t["target"]))
    cite = F.concat(F.lit(MANIFEST_BLOB_BASE), F.col("manifest"))
    cite = F.when(F.col("manifest_line").isNotNull(), F.concat(cite, F.lit("#L"), F.col("manifest_line").cast("string"))).otherwise(cite)
    return g.select(
        F.concat(F.lit("e18e:"), F.col("manifest"), F.lit(":"), F.col("from_name")).alias("id"),
        F.concat(F.lit("pkg:npm/"), F.col("from_name")).alias("from_purl"),
        F.when(F.size("__t") > 0, targets).otherwise(F.array(F.lit(NATIVE_TARGET))).alias("to_purls"),
        F.col("axis"),
        effort.alias("effort"),
        F.col("manifest"),
        F.col("manifest_line").cast("bigint").alias("manifest_line"),
        F.struct(
            cite.alias("citation_url"),
            F.array_join(F.transform("__ids", lambda x: x["rid"]), ",").alias("ids"),
            F.col("manifest"),
            F.col("manifest_line").cast("bigint").alias("manifest_line"),
            F.lit(EVIDENCE_SOURCE).alias("source"),
        ).alias("evidence"),
        F.col("k").cast("bigint").alias("seq"),
    )
