"""Prompts for a remote scorer and parsing of its replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bellwire.functions.numbers import clamp
from bellwire.functions.text import blank_if_null, strip

# Fixed value: an optional sign and a plain decimal, nothing else; no exponent.
NUMBER_REPLY = r"\A[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"

_RANGE = "Answer with one number from -1.00 (very bad) to 1.00 (very good), and nothing else."
PROMPTS = {
    "zero_shot": f"How good is this news for the companies or markets it is about? {_RANGE}\nNews: {{headline}}",
    "few_shot": (
        f"Rate the financial tone of a news line. {_RANGE}\n"
        "News: Shares slump after profit warning\nAnswer: -0.80\n"
        "News: City council repaints bridge\nAnswer: 0.00\n"
        "News: Retailer lifts full-year outlook\nAnswer: 0.70\n"
        "News: {headline}\nAnswer:"
    ),
    "market_zero_shot": (
        f"Does this news point to stocks rising or falling in today's session? {_RANGE}\nNews: {{headline}}"
    ),
}


def format_prompt(headline: Column | str, key: str = "zero_shot") -> Column:
    text = F.col(headline) if isinstance(headline, str) else headline
    return F.replace(F.lit(PROMPTS[key]), F.lit("{headline}"), blank_if_null(text))


def parse_score(reply: Column | str) -> Column:
    """The reply as a score in [-1, 1], NULL when it is anything but a plain number."""
    text = strip(reply)
    return clamp(F.when(text.rlike(NUMBER_REPLY), text.try_cast("double")), -1.0, 1.0)


def _safe(name: str) -> str:
    return re.sub(r"[-. ]", "_", name)


def score_column(model: str, prompt: str) -> str:
    """Column for one model and prompt, with dashes and dots removed."""
    return f"llm_sentiment_score_{model}_{prompt}".replace("-", "").replace(".", "")


def source_column(base: str, source: str) -> str:
    """``base`` plus a source suffix; dots, dashes and blanks become underscores."""
    return f"{base}_{_safe(source)}"


def source_suffix(col: Column | str) -> Column:
    """The suffix ``source_column`` appends, for a column of source names."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, "[-. ]", "_")
