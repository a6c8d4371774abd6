"""Quality of texts in DataFrame functions only: counts, repeats, and a trusted-against-raw n-gram ratio.

Words are the stretches between the blanks 0x20 and 0x09-0x0D. Words and pairs of neighbouring words
are hashed into a fixed number of buckets. Two multinomials over the buckets are counted in one pass:
the raw one over every row, the trusted one over every row labelled good, so both grow with the input.
A text's verdict is the mean log ratio of trusted to raw over its buckets against a fixed threshold, so it
does not depend on length or on other rows' scores.

Null texts have no words. A text without words has score 0 and fails the base rules. Without trusted
rows every score is 0. Repeated rows are counted and judged like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwire.session import broadcast_if_small, materialise

BUCKETS, SMOOTH = 1 << 15, 1.0
#: Trusted ids may be broadcast up to this many (12 bytes each); beyond, whole texts are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Mean log ratio from which a text is kept.
THRESHOLD = -0.18
WINDOW = 8
_GAP = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def literal_array(values: list[float]) -> Column:
    """A constant array of doubles, folded by the optimiser into one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def word_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of each word in the lower half, of each pair of neighbours in the upper half."""
    half = buckets // 2
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(half)).cast("int"))
    pair = F.transform(
        hashes,
        lambda h, i: (F.pmod(h.bitwiseXOR(F.shiftright(F.coalesce(F.get(hashes, i + 1), F.lit(0)), 1)), F.lit(half)) + half).cast("int"),
    )
    return F.concat(single, pair)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))


def hashed_words(words: DataFrame) -> DataFrame:
    """The hash of every word of ``t`` in order, as another column."""
    return words.withColumn("hashes", F.transform(words_of(F.col("t")), lambda w: F.xxhash64(w)))


def ratio_weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, buckets: int) -> list[float]:
    """Log ratio of trusted to raw per bucket; one number per bucket comes to the driver."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id")).distinct()
    good = broadcast_if_small(materialise(good.withColumn("good", F.lit(1)), "trusted"), BROADCAST_IDS)
    rows = hashed_words(texts_of(docs, id_col, text_col).join(good, "id", "left"))
    seen = rows.select("good", F.explode(word_buckets(F.col("hashes"), buckets)).alias("b"))
    counts = {r.b: (r.raw, r.trusted or 0) for r in seen.groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("trusted")).collect()}
    raw, target = sum(x for x, _ in counts.values()), sum(y for _, y in counts.values())
    if not target:
        return [0.0] * buckets

    def ratio(b: int) -> float:
        x, y = counts.get(b, (0, 0))
        return round(math.log((y + SMOOTH) / (target + SMOOTH * buckets)) - math.log((x + SMOOTH) / (raw + SMOOTH * buckets)), 6)

    return [ratio(b) for b in range(buckets)]


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per row: id, the counts, ``base_failed``, ``score`` and ``kept``."""
    weights = literal_array(ratio_weights(docs, labels, id_col, text_col, label_col, buckets))
    text = F.coalesce(F.col("t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, _BLANKS) != "")
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    # Arrays that a lambda looks into are columns of their own, so they are computed once per row.
    rows = hashed_words(texts_of(docs, id_col, text_col))
    rows = rows.select(
        "id",
        "hashes",
        F.size("hashes").cast("bigint").alias("n_words"),
        F.length(without(text, _BLANKS)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(without(text, "#*$%&|<>"))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    rows = rows.select(
        "id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
        word_buckets(F.col("hashes"), buckets).alias("buckets"),
    )
    twice = F.transform(
        "sorted",
        lambda x, i: F.when((x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]), x["i"]),
    )
    rows = rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("sorted").isNotNull(), F.array_sort(F.array_compact(twice))).alias("places"),
        (F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.greatest(F.size("buckets"), F.lit(1))).alias("score"),
    )
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1), p + WINDOW) - p)), F.lit(0), lambda a, b: a + b
    )
    rows = rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("places").isNotNull(), covered).otherwise(0).cast("bigint").alias("n_repeat_words"), "score",
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
