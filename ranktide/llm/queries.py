"""The registered queries of the subpackage: one per operator, thin over its module."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ranktide.llm.common import ship


@dataclass(frozen=True)
class Query:
    apply: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def build(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return self.apply(spark, sf_dir)


def load_llm() -> dict[str, Query]:
    from ranktide.llm import bpe, fingerprint, language, merkle_manifest, middle, ngram_join, packing, ppm, sharding, suffix_dedup, token_files, topk, word_trie

    return {
        "op10_language": Query(language.op10_language),
        "op11_manifest": Query(merkle_manifest.op11_manifest, merkle_manifest.ORACLE_SQL),
        "op12_word_trie": Query(word_trie.op12_word_trie),
        "op13_middle": Query(middle.op13_middle, middle.ORACLE_SQL),
        "op1_suffix_dedup": Query(suffix_dedup.op1_suffix_dedup),
        "op3_ppm": Query(ppm.op3_ppm),
        "op4_ngram_join": Query(ngram_join.op4_ngram_join, ngram_join.ORACLE_SQL),
        "op4_ngram_links": Query(ngram_join.op4_ngram_links, ngram_join.LINKS_SQL),
        "op2_token_files": Query(token_files.op2_token_files),
        "op5_byte_bpe": Query(bpe.op5_byte_bpe),
        "op6_sharding": Query(sharding.op6_sharding, sharding.ORACLE_SQL),
        "op7_packing": Query(packing.op7_packing),
        "op8_fingerprints": Query(fingerprint.op8_fingerprints, fingerprint.ORACLE_SQL),
        "op9_top_k": Query(topk.op9_top_k, topk.ORACLE_SQL),
    }
