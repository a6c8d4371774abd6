"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bellwire.llm import bpe, counts, hilbert, language, lexical, mixing, neardup, packing, pages, quality, repair, toxicity, whitening
from bellwire.registry.base import entry


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies on this machine; the same package is on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_repair(spark, sf_dir):
    return repair.token_shards(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3)


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_hilbert(spark, sf_dir):
    return hilbert.nearest(table(spark, sf_dir, "embeddings"))


def op3_html(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical(spark, sf_dir):
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


ENTRIES = {
    "op11_lexical": entry(op11_lexical, lexical.SQL),
    "op12_packing": entry(op12_packing),
    "op13_whitening": entry(op13_whitening),
    "op3_html": entry(op3_html),
    "op8_quality": entry(op8_quality),
    "op10_mixing": entry(op10_mixing),
    "op2_toxicity": entry(op2_toxicity),
    "op5_language": entry(op5_language),
    "op9_hilbert": entry(op9_hilbert),
    "op1_bpe": entry(op1_bpe),
    "op4_repair": entry(op4_repair),
    "op6_counts": entry(op6_counts),
    "op7_neardup": entry(op7_neardup),
}
