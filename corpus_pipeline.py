"""The corpus pipeline: documents -> packed token sequences.

Each stage is one operator of ``ranktide.llm`` over all documents that the
stage before it kept; all but the last return the columns of ``documents``.

1. language: documents in none of the learned languages go: those that need
   more bits a symbol than nearly all other labelled texts of the language
   they are nearest to (``limits``).
2. near_duplicates: of each group of documents linked by the n-gram join, the
   one of the smallest doc_id stays (null ids last, then by the text's hash).
3. repeats: byte strings of ``PASSAGE`` bytes (fewer than fifty words have) that
   occur more than once stay in the document of the smallest doc_id and are cut
   out elsewhere; documents left without a letter or digit go.
4. packing: the rest is packed into sequences of at most 1024 tokens.

Defined results: null, empty and letterless texts go in the first stage; an
empty table gives no rows at every stage; repeated rows count as copies, of
which one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm import language, ngram_join, packing, suffix_dedup
from ranktide.llm.common import ship, staged, text_keys

#: A text this long (bytes) that needs more bits a symbol than its language's limit is in no learned language. A limit is
#: the ``QUANTILE`` of the rates of the labelled texts that weren't learned from, times ``MARGIN``. Of fewer than
#: ``LEAST_TEXTS`` such texts none is derived: all languages' texts together give it, or it is ``MOST_BITS``.
LEAST_SYMBOLS, QUANTILE, MARGIN, LEAST_TEXTS, MOST_BITS = 32, 0.99, 1.6, 100, 8.0
PASSAGE = 150  # bytes; fifty-one words in a row are longer


def _all(docs: DataFrame) -> list[Column]:
    """All columns, by whatever name."""
    return [F.col(f"`{c}`") for c in docs.columns]


def limits(docs: DataFrame, model: language.Classifier) -> tuple[dict[str, float], float]:
    """The most bits a symbol of each language with enough labelled texts that weren't learned from, and of any other."""
    fresh = docs.where(F.col("lang").isin(model.langs) & ~F.xxhash64("text").isin(model.learned))
    rates = language.identify(fresh.where(F.octet_length("text") >= LEAST_SYMBOLS).select("lang", "text"), model, "lang")
    high = F.percentile_approx("rate", QUANTILE, 10000).alias("high")
    found = rates.where("rate IS NOT NULL").rollup("lang").agg(F.count("*").alias("n"), high).where(F.col("n") >= LEAST_TEXTS)
    by = {r["lang"]: MARGIN * r["high"] for r in found.collect()}  # a row for each learned language and one for all
    other = by.pop(None, MOST_BITS)
    return by, other


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and longer ones that no learned language explains."""
    ship(spark)
    model = language.fit(docs)
    by, other = limits(docs, model)
    found = language.identify(docs.select(F.struct(*_all(docs)).alias("row"), "text"), model, "row")
    most = F.lit(other)
    for lang, bits in by.items():
        most = F.when(F.col("lang_pred") == lang, bits).otherwise(most)
    foreign = (F.col("rate") > most) & (F.octet_length("row.text") >= LEAST_SYMBOLS)
    return found.where((F.col("lang_pred") != "und") & ~foreign).select("row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, and every document that is in none."""
    ship(spark)
    known = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    keys = ["id", "no_id", "k1", "k2"]
    verdict = ngram_join.near_duplicates(docs).select(*known, "k1", "k2", "component").distinct()
    first = verdict.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct("no_id", "id", "k1", "k2")).alias("first")
    )
    stay = (
        verdict.where("component IS NULL").select(*keys, F.lit(False).alias("grouped"))
        .unionByName(first.select("first.id", "first.no_id", "first.k1", "first.k2", F.lit(True).alias("grouped")))
    )
    rows = docs.select(F.struct(*_all(docs)).alias("row"), *known, *text_keys())
    kept = rows.join(stay, keys)
    # Copies of a kept row that share even its id are one row; documents in no group stay as they are.
    own = F.when(F.col("grouped"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return kept.withColumn("own", own).dropDuplicates([*keys, "own"]).select("row.*")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of passages that occur more than once."""
    ship(spark)
    rows = docs.select(F.struct(*_all(docs)).alias("row"), "doc_id", "text")
    left = suffix_dedup.remove_repeats(rows, "row", window=PASSAGE, as_text=True, keep_first=True)
    # A text of which only marks and blanks are left says nothing.
    left = left.where((F.col("kept") != "") & ((F.col("n_removed") == 0) | F.col("kept").rlike(r"[\p{L}\p{N}]")))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the rest into sequences, with the pieces' ids."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # no stage can be said in SQL; tests hold each against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all of ``documents``; every stage's rows are written and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
