"""Fill-in-the-middle transformation by counted quantifiers, as Column expressions.

A text is cut into n units (a word with the white space before it, or white
space at the end). Of a document's own digest come two cuts among the n + 1
borders and its form. ``regexp_count`` gives n; each row then has a pattern of
its own, ``(unit{a}+)(unit{b - a}+)(.*)``, whose three groups are prefix, middle
and suffix in one match, and whose replacement writes them in the form's order.
The quantifiers are possessive, so the match runs as a loop: it never goes back
into a unit, and its stack doesn't grow with the text.

Forms: ``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each
part behind its marker; ``plain`` is the text as it is. ``restored`` gives the text
again: a part holds no marker, and none can come about where two parts meet.

Defined results: a null text is empty; an empty text, or one that holds a marker
itself, is plain; a text of white space only is one unit; a document without id
draws as if its id were written with no digits. Repeated rows draw alike. The
columns kept go by any name: those of the result come after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import documents

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED, RATE, SPM_SHARE = 42, 50, 80  # RATE % of the documents are cut; SPM_SHARE % of these are spm
P, S, M = MARKERS = "<P>", "<S>", "<M>"


def _pattern(a: Column, b: Column) -> Column:
    """The pattern that cuts a text after ``a`` and after ``b`` units."""
    times = lambda k: F.concat(F.lit(f"((?:{UNIT}){{"), k.cast("string"), F.lit("}+)"))
    return F.concat(F.lit(r"(?s)\A"), times(a), times(b - a), F.lit(r"(.*)\z"))


def _drawn(group: int) -> Column:
    """One of the digest's 8-digit groups, counted from 0, as a number."""
    return F.conv(F.substring("_digest", 1 + 8 * group, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *keep: str, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """The ``keep`` columns of every row with n (units), form, prefix_chars, middle_chars (null: plain) and output."""
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)],
        F.coalesce("text", F.lit("")).alias("_text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("_digest"),
    )
    rows = rows.withColumn("_n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    own_marker = F.lit(False)
    for m in MARKERS:
        own_marker |= F.contains("_text", F.lit(m))
    form = (
        F.when((F.col("_text") == "") | own_marker | (_drawn(2) % 100 >= rate), "plain")
        .when(_drawn(3) % 100 < spm_share, "spm").otherwise("psm")
    )
    one, other = (_drawn(i) % (F.col("_n") + 1) for i in (0, 1))
    rows = rows.withColumns({"_form": form, "_a": F.least(one, other), "_b": F.greatest(one, other)})
    order = F.when(F.col("_form") == "psm", f"{P}$1{S}$3{M}$2").otherwise(f"{S}$3{P}$1{M}$2")
    plain = F.col("_form") == "plain"
    rows = rows.withColumn(
        "_out", F.when(plain, F.col("_text")).otherwise(F.regexp_replace("_text", _pattern(F.col("_a"), F.col("_b")), order))
    )
    at = {m: F.locate(m, F.col("_out")).cast("long") for m in MARKERS}
    prefix = F.when(F.col("_form") == "psm", at[S] - at[P]).otherwise(at[M] - at[P]) - len(P)
    middle = F.char_length("_out") + 1 - at[M] - len(M)
    return rows.select(
        *[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)],
        F.col("_n").alias("n"), F.col("_form").alias("form"),
        F.when(~plain, prefix).alias("prefix_chars"), F.when(~plain, middle).alias("middle_chars"),
        F.col("_out").alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that a row's output and form were made of."""
    psm = F.regexp_replace(output, rf"(?s)\A{P}(.*){S}(.*){M}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{S}(.*){P}(.*){M}(.*)\z", "$2$3$1")
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts; digests stand for the output and the text restored from it."""
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return fill_in_middle(documents(spark, sf_dir), "doc_id").select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
h AS (SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
             ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
             array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
