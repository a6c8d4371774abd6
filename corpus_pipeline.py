"""From raw documents to encoded training text: five stages, each on all that the one before kept.

Stages read and return the columns of ``documents``; the last returns the encoding per document row.
Extra columns pass through. Null texts survive the filters where a rule below does not name them:
toxicity scores them as texts without a mark, language calls them ``und`` and drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwire.llm import bpe, language, mixing, neardup, toxicity
from bellwire.llm.registry import table, tokenizer_path
from bellwire.llm.sample import restored
from bellwire.session import configure, materialise, small_batches

#: Dropped ids may be broadcast up to this many (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose predicted label is 0."""
    small_batches(spark)
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return scored.where("predicted = 0").select(*restored(docs.columns))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows with a letter whose best language has at least half of the posterior."""
    small_batches(spark)
    named = language.predict(docs, tokenizer_path("piece_bpe_32k.model"), carry=tuple(docs.columns))
    return named.where("lang_pred <> 'und' and score >= 0.5").select(*restored(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; rows with a null id stay."""
    small_batches(spark)
    found = neardup.near_duplicates(docs, num=80, den=100, width=5)
    extra = materialise(found.where("not kept").select("doc_id").distinct(), "extra")
    small = extra.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(extra) if small else extra, "doc_id", "left_anti").select(*docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows at their fitted rate; every document stays at least once."""
    small_batches(spark)
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), carry=docs.columns, at_least=1)
    return mixed.withColumn("_nth", F.explode(F.sequence(F.lit(1), "copies"))).select(*restored(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, as counts and digests."""
    small_batches(spark)
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_languages),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is written as Parquet and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The models, minimum hashes and merges have no SQL form; tests compare with plain versions.
ORACLE_SQL = None
