"""Declared schemas of the stored tables."""

from pyspark.sql import types as T

SOURCE_HEADLINES = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("published_at", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

HEADLINES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("published_at", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("trade_id", T.LongType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("open_price", T.DoubleType()),
        T.StructField("close_price", T.DoubleType()),
        T.StructField("high_price", T.DoubleType()),
        T.StructField("low_price", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

ARTICLE_PAGE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("totalResults", T.LongType()),
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("title", T.StringType()),
                        T.StructField("publishedAt", T.StringType()),
                        T.StructField("url", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

LEXICON_SOURCE = T.StructType(
    [
        T.StructField("Word", T.StringType()),
        T.StructField("Positive", T.DoubleType()),
        T.StructField("Negative", T.DoubleType()),
    ]
)

LEXICON = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("polarity", T.IntegerType())]
)
