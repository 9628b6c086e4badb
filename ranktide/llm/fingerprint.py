"""Merkle fingerprints of documents: a tree over sections and paragraphs, in DataFrame functions only.

A text is cut into paragraphs: runs of at most ``PARAGRAPH`` characters other
than line and sentence ends, with the ends and white space that follow. A
paragraph whose hash falls in a fixed eighth of all hashes closes a section, so
an edit moves section borders only near itself. The tree is written into one
string, ``root|section:leaf.leaf...;section:...``: the root is the digest of
all section hashes, a section's hash the digest of its leaves' hashes, a leaf's
the digest of its paragraph.

Equal roots mean equal texts. Where roots differ, the branches that the trees
don't share locate the edit: ``differing`` lists the paragraphs of one tree
that the other lacks. ``likeness`` is Dice's coefficient of the trees' distinct
paragraph hashes, and 1 only for equal roots.

Defined results: a null text is empty and its tree has a root only; two empty
texts have likeness 1; repeated rows are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.functions.util import let
from ranktide.llm.common import documents, partitions, staged

PARAGRAPH = 48
LEAF, SECTION, ROOT = 8, 8, 32  # hexadecimal digits written of each digest

#: A run of ordinary characters with the ends that follow, or ends alone: every character is in one match.
_PARAGRAPHS = r"[^\n.!?]{1,%d}[ \t\r\n.!?]*|[ \t\r\n.!?]+"


def paragraphs(text: Column, most: int = PARAGRAPH) -> Column:
    """The paragraphs, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(_PARAGRAPHS % most), F.lit(0))


def _written(section: Column) -> Column:
    leaves = F.transform(F.split(section, "[.]"), lambda h: F.substring(h, 1, LEAF))
    return F.concat(F.substring(F.md5(section), 1, SECTION), F.lit(":"), F.array_join(leaves, "."))


def fingerprint(text: Column) -> Column:
    """The tree of a text (null as empty) as a string."""
    leaves = F.transform(paragraphs(F.coalesce(text, F.lit(""))), lambda p: F.md5(p))
    # A leaf's last digit decides whether it closes its section.
    closed = F.transform(leaves, lambda h: F.concat(h, F.when(F.substring(h, 32, 1).isin("0", "8"), ";").otherwise(".")))
    sections = F.filter(F.split(F.rtrim(F.array_join(closed, ""), F.lit(".;")), ";"), lambda s: s != "")
    return let(sections, lambda x: F.concat(
        F.substring(F.sha2(F.array_join(F.transform(x, lambda s: F.md5(s)), ""), 256), 1, ROOT),
        F.lit("|"),
        F.array_join(F.transform(x, _written), ";"),
    ))


def leaves_of(tree: Column) -> Column:
    """The paragraph hashes of a tree, in order."""
    body = F.regexp_replace(F.substring_index(tree, "|", -1), "(^|;)[0-9a-f]+:", "$1")
    return F.filter(F.split(body, "[.;]"), lambda h: h != "")


def differing(tree: Column, other: Column) -> Column:
    """Places (from 0) of the paragraphs of ``tree`` whose hash ``other`` lacks."""
    places = let(F.array_except(leaves_of(tree), leaves_of(other)), lambda lacks: F.transform(
        leaves_of(tree), lambda h, i: F.when(F.array_contains(lacks, h), i)
    ))
    return F.filter(places, lambda i: i.isNotNull())


def likeness(tree: Column, other: Column) -> Column:
    def dice(a: Column, b: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))

    same = F.substring_index(tree, "|", 1) == F.substring_index(other, "|", 1)
    near = let(F.array_distinct(leaves_of(tree)), lambda a: let(F.array_distinct(leaves_of(other)), lambda b: dice(a, b)))
    return F.when(same, F.lit(1.0)).otherwise(F.least(near, F.lit(1 - 1e-9)))


def next_ids(docs: DataFrame) -> DataFrame:
    """``doc_id`` -> ``next_id``, the next in descending order; after the last, the first. One row per distinct id.

    Ids are dealt by ranges, written once, and each range looks back within
    itself; only the ranges' largest ids meet in one place.
    """
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    n = partitions(docs)
    rows = staged(ids.repartitionByRange(n, "doc_id").select("doc_id", F.spark_partition_id().alias("part")), "doc-order")
    ends = rows.groupBy("part").agg(F.max("doc_id").alias("top"))  # one row a range
    by_part = Window.orderBy("part")
    every = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("top").over(by_part), F.max("top").over(every)).alias("before"))
    inside = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return rows.withColumn("inside", inside).join(ends, "part").select(
        "doc_id", F.coalesce("inside", "before").alias("next_id")
    )


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with ``next_text``, the text of the next document in descending ``doc_id`` order.

    Rows with one id share their place: the next text is the least of the next
    id's. Rows without an id are followed by themselves.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known, unknown = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    # A text goes to the document that it follows: the rows dealt by id serve both joins, so texts move twice.
    follows = next_ids(docs).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"))
    sent = known.join(follows, "doc_id").groupBy("for_id").agg(F.min("text").alias("next_text"))
    return (
        known.join(sent.withColumnRenamed("for_id", "doc_id"), "doc_id")
        .unionByName(unknown.withColumn("next_text", F.col("text")))
    )


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text: the last floor(n/2) code points replaced by the first as many
    (or all) of the next document's."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, and their likeness to the edited text's and the next document's."""
    rows = compare_with_edits(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n,
             coalesce(lead(text) OVER (ORDER BY doc_id DESC),
                      first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT doc_id, text, n, next_text,
             substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM o),
t AS (SELECT doc_id, 'a' AS kind, text AS x FROM e UNION ALL
      SELECT doc_id, 'b', edited FROM e UNION ALL SELECT doc_id, 'c', next_text FROM e),
l AS (SELECT doc_id, kind, list_transform(regexp_extract_all(x, '{_PARAGRAPHS % PARAGRAPH}'), lambda p: md5(p)) AS leaves FROM t),
j AS (SELECT doc_id, kind, rtrim(array_to_string(list_transform(leaves, lambda h:
             h || CASE WHEN right(h, 1) IN ('0', '8') THEN ';' ELSE '.' END), ''), '.;') AS joined FROM l),
s AS (SELECT doc_id, kind, list_filter(string_split(joined, ';'), lambda s: s <> '') AS sections,
             list_filter(string_split_regex(joined, '[.;]'), lambda h: h <> '') AS hashes FROM j),
f AS (SELECT doc_id, kind,
             left(sha256(array_to_string(list_transform(sections, lambda s: md5(s)), '')), {ROOT}) AS root,
             array_to_string(list_transform(sections, lambda s: left(md5(s), {SECTION}) || ':' ||
               array_to_string(list_transform(string_split(s, '.'), lambda h: left(h, {LEAF})), '.')), ';') AS body,
             list_distinct(list_transform(hashes, lambda h: left(h, {LEAF}))) AS leaf FROM s)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256,
       a.root || '|' || a.body AS fingerprint, b.root || '|' || b.body AS edited_fingerprint,
       CASE WHEN a.root = b.root THEN 1.0 ELSE least(2.0::DOUBLE * len(list_intersect(a.leaf, b.leaf))
            / greatest(len(a.leaf) + len(b.leaf), 1), (1 - 1e-9)::DOUBLE) END::DOUBLE AS near_edited,
       CASE WHEN a.root = c.root THEN 1.0 ELSE least(2.0::DOUBLE * len(list_intersect(a.leaf, c.leaf))
            / greatest(len(a.leaf) + len(c.leaf), 1), (1 - 1e-9)::DOUBLE) END::DOUBLE AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 'a'
       JOIN f b ON b.doc_id = e.doc_id AND b.kind = 'b'
       JOIN f c ON c.doc_id = e.doc_id AND c.kind = 'c'
"""
