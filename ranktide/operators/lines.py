"""Line-scan jobs over landed text documents (manifests, lockfiles).

Dependency sections and lockfile mappings are folds over a document's lines inside
its row (``operators.folds``): the state machine's state is the fold's, what it
finds is an array, and only that leaves the row. Manifests that come as a line
table are scanned by aggregates and chunked running sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.functions.util import let
from ranktide.operators.folds import CHUNK, first_of_each, fold_lines
from ranktide.operators.yaml_keys import yaml_keys

# Fixed values.
DEP_SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
DEP_SECTION_PATTERN = r'^\s*"(dependencies|devDependencies|optionalDependencies|peerDependencies)"\s*:\s*\{'
JSON_KEY_PATTERN = r'^\s*"([^"]+)"\s*:'
MAPPING_KEY_PATTERN = r'^\s*"([^"]+)"\s*:\s*\{'
# End of fixed values.


def to_lines(docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per line, 1-based ``line_no`` (NULL text -> no lines)."""
    x = docs.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    return x.select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def with_depth(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``delta`` (opens - closes), ``d_before`` (running depth before the line) and ``d_after`` to a line table."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("delta", count_char(F.col("line"), "{") - count_char(F.col("line"), "}"))
    x = x.withColumn("d_before", F.coalesce(F.sum("delta").over(w), F.lit(0)))
    return x.withColumn("d_after", F.col("d_before") + F.col("delta"))


def dep_section_lines(text: Column, chunk: int = CHUNK) -> Column:
    """The lines inside a dependency section: ``array<struct<line_no, section, name>>``; ``name`` is null where the line
    declares no dependency.

    A section opens on a header line (brace on the same line) and stays open until a
    line brings the depth below that after its header (that closing line still
    belongs to it). A header is never a dependency, and opens its section wherever
    it stands, also after an empty section (``"dependencies": {},``).
    """
    found = "struct<line_no:int,section:string,name:string>"
    none = F.array().cast(f"array<{found}>")

    def inside(s: Column, name: Column, number: Column) -> Column:
        line = F.struct(number.cast("int").alias("line_no"), s["section"].alias("section"), name.alias("name"))
        return F.when(s["section"].isNotNull(), F.array(line)).otherwise(none).alias("found")

    def with_braces(s: Column, line: Column, number: Column) -> Column:
        def known(x: Column) -> Column:
            header, after = x["header"] != "", s["depth"] + x["delta"]
            open_ = s["section"].isNotNull() & (after >= s["base"])
            return F.struct(
                after.alias("depth"), F.when(header, x["header"]).when(open_, s["section"]).alias("section"),
                F.when(header, after).otherwise(s["base"]).alias("base"), inside(s, F.when(~header, declared(s, line)), number),
            )

        return let(F.struct(
            (count_char(line, "{") - count_char(line, "}")).alias("delta"), F.regexp_extract(line, DEP_SECTION_PATTERN, 1).alias("header"),
        ), known)

    def declared(s: Column, line: Column) -> Column:
        return F.when(s["depth"] == s["base"], F.nullif(F.regexp_extract(line, JSON_KEY_PATTERN, 1), F.lit("")))

    def step(s: Column, line: Column, number: Column) -> Column:
        same = F.struct(s["depth"].alias("depth"), s["section"].alias("section"), s["base"].alias("base"), inside(s, declared(s, line), number))
        return F.when(line.contains("{") | line.contains("}"), with_braces(s, line, number)).otherwise(same)

    start = {"depth": F.lit(0), "section": F.lit(None).cast("string"), "base": F.lit(0)}
    return fold_lines(text, start, found, step, chunk=chunk)


def declared_lines(text: Column) -> Column:
    """The first line that declares each dependency in one of the four sections: ``array<struct<line_no, section, name>>``."""
    return first_of_each(F.filter(dep_section_lines(text), lambda x: x["name"].isNotNull()), "name")


def man_dep_lines(docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """First 1-based line declaring each dependency inside one of the four dependency sections."""
    hits = docs.select(*keys, F.inline(declared_lines(F.col(text_col))))
    return hits.select(*keys, "name", F.col("line_no").alias("line"))


def running_sum_chunked(df: DataFrame, keys: Sequence[str], value: str, out: str, chunk: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` over ``line_no`` per document, in bounded windows.

    Lines are cut into chunks of ``chunk`` lines: per-chunk totals (an
    aggregate), chunk offsets (a window over at most N / chunk rows per
    document) and an in-chunk running sum (a window over at most ``chunk``
    rows). A single huge document is therefore spread over many tasks.
    """
    x = df.withColumn("__chunk", F.floor((F.col("line_no") - 1) / chunk))
    tot = x.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__t"))
    ow = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("__off", F.coalesce(F.sum("__t").over(ow), F.lit(0))).drop("__t")
    iw = Window.partitionBy(*keys, "__chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__in", F.coalesce(F.sum(value).over(iw), F.lit(0)))
    return x.join(off, [*keys, "__chunk"]).withColumn(out, F.col("__off") + F.col("__in")).drop("__chunk", "__off", "__in")


def src_manifest_line_index(lines: DataFrame, keys: Sequence[str], chunk: int = 4096) -> DataFrame:
    """1-based line of each depth-1 key inside the ``mappings`` block (last duplicate wins).

    The block starts at the first line mentioning ``"mappings"`` and a colon,
    and ends at the first later line whose depth drops to zero. Start and end
    are plain aggregates per document; the depth is a chunked running sum, so
    no window ever holds more than ``chunk`` lines.
    """
    x = lines.withColumn("delta", count_char(F.col("line"), "{") - count_char(F.col("line"), "}"))
    x = running_sum_chunked(x, keys, "delta", "d_before", chunk).withColumn("d_after", F.col("d_before") + F.col("delta"))
    is_start = F.col("line").contains('"mappings"') & F.col("line").contains(":")
    start = x.where(is_start).groupBy(*keys).agg(F.min_by("d_before", "line_no").alias("__base"), F.min("line_no").alias("__start"))
    y = x.join(start, list(keys)).where(F.col("line_no") > F.col("__start"))
    end = y.where(F.col("d_after") - F.col("__base") <= 0).groupBy(*keys).agg(F.min("line_no").alias("__end"))
    y = y.join(end, list(keys), "left").where(F.col("__end").isNull() | (F.col("line_no") <= F.col("__end")))
    key = F.regexp_extract("line", MAPPING_KEY_PATTERN, 1)
    hits = y.where((F.col("d_before") - F.col("__base") == 1) & (key != ""))
    return hits.groupBy(*keys, key.alias("key")).agg(F.max("line_no").cast("int").alias("line"))


def lockfile_keys(text: Column) -> Column:
    """The dependencies in the ``importers`` mapping of a pnpm lockfile, in any block or flow style:
    ``array<struct<workspace, section, dep, line_no>>``, empty if the text is no valid YAML."""

    def pick(path: Column, number: Column) -> Column:
        names = [F.get(path, F.lit(i)) for i in range(4)]
        declares = (
            (F.size(path) == 4) & (names[0] == "importers") & names[2].isin(*DEP_SECTIONS) & names[1].isNotNull() & (names[3] != "<<")
        )
        return F.when(declares, F.struct(
            names[1].alias("workspace"), names[2].alias("section"), names[3].alias("dep"), number.cast("int").alias("line_no")
        ))

    return yaml_keys(text, "struct<workspace:string,section:string,dep:string,line_no:int>", pick)


def man_lockfile_importers(docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(workspace, section, dep, line_no) rows of the ``importers`` mapping of pnpm lockfiles.

    A lockfile that is no valid YAML gives no rows, which the caller treats as unknown.
    """
    return docs.select(*keys, F.inline(lockfile_keys(F.col(text_col))))
