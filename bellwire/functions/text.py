"""Text functions with Python's Unicode rules for words and blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, as a regex class body.
BLANKS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Word characters: letters, numbers of any kind, underscore. Java's bare \w is ASCII only.
WORD = r"\p{L}\p{N}_"

# A cheap ASCII class is tested first, so plain letters skip the long Unicode lists; the set of
# matching characters stays the same.
_NOT_WORD_NOR_BLANK = rf"[[^\w ]&&[^{WORD}{BLANKS}]]"
_EDGE_BLANKS = rf"\A[{BLANKS}]+|[{BLANKS}]+\z"
_TOKEN = rf"[\w[{WORD}]]+"

# Printable ASCII plus tab, line feed, vertical tab, form feed, carriage return.
_ALL_PRINTABLE = r"\A[\x20-\x7E\t\n\x0B\f\r]*\z"
_ANY_ALNUM = r"[A-Za-z0-9]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(col: Column | str) -> Column:
    """Trim every Unicode blank, not only the space character."""
    return F.regexp_replace(_col(col), _EDGE_BLANKS, "")


def clean_title(col: Column | str) -> Column:
    """Drop punctuation, collapse blanks, trim, lower. NULL stays NULL.

    Without punctuation only words and blanks are left, so joining the words by one space both
    collapses and trims, and runs several times faster than replacing blank runs.
    """
    kept = F.regexp_replace(_col(col), _NOT_WORD_NOR_BLANK, "")
    return F.lower(F.array_join(F.regexp_extract_all(kept, F.lit(_TOKEN), F.lit(0)), " "))


def tokens(col: Column | str) -> Column:
    """Word tokens of the lower-cased text, in order, with repeats."""
    return F.regexp_extract_all(F.lower(_col(col)), F.lit(_TOKEN), F.lit(0))


def is_valid_title(col: Column | str) -> Column:
    """Printable ASCII with at least one letter or digit. NULL and '' count as valid."""
    col = _col(col)
    return col.isNull() | (col == "") | (col.rlike(_ALL_PRINTABLE) & col.rlike(_ANY_ALNUM))


def source_from_domain(col: Column | str) -> Column:
    """``Wsj.com`` -> ``wsj``: the text before the first dot, lower-cased."""
    return F.lower(F.substring_index(_col(col), ".", 1))


def blank_if_null(col: Column | str) -> Column:
    return F.coalesce(_col(col), F.lit(""))
