"""Word lists with polarity: built from a flag table, or read from one-word-per-line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwire.functions.numbers import numeric
from bellwire.functions.text import strip


def build_lexicon(flags: DataFrame) -> DataFrame:
    """(word, polarity) from a table with Word, Positive and Negative; a flag above 0 counts."""
    signs = F.array(
        F.when(numeric("Positive") > 0, F.lit(1)), F.when(numeric("Negative") > 0, F.lit(-1))
    )
    return (
        flags.where(F.col("Word").isNotNull())
        .select(F.lower("Word").alias("word"), F.explode(signs).alias("polarity"))
        .where(F.col("polarity").isNotNull())
        .distinct()
    )


def write_word_list(lexicon: DataFrame, polarity: int, path: str) -> str:
    """One word per line, sorted."""
    words = lexicon.where(F.col("polarity") == polarity).select("word").orderBy("word")
    words.write.text(path)
    return path


def read_word_list(spark: SparkSession, path: str, polarity: int) -> DataFrame:
    words = spark.read.text(path).select(F.lower(strip("value")).alias("word"))
    return words.where(F.col("word") != "").distinct().withColumn("polarity", F.lit(polarity))


def read_lexicon(spark: SparkSession, positive_path: str, negative_path: str) -> DataFrame:
    """Both lists; a word in both counts as positive, because it is looked up there first."""
    both = read_word_list(spark, positive_path, 1).unionByName(read_word_list(spark, negative_path, -1))
    return positive_first(both)


def positive_first(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("word").agg(F.max("polarity").alias("polarity"))
