"""Time handling. Instants travel as ``timestamp_ntz`` holding UTC wall time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_utc(col: Column | str) -> Column:
    """Parse ISO text, each row by itself, to UTC wall time; junk and NULL give NULL.

    Text without an offset counts as UTC. A leading year is required, because a bare time of day
    would otherwise parse as today.
    """
    col = _col(col)
    parsed = F.try_to_timestamp(F.when(col.rlike(r"^\s*\d{4}-"), col))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), parsed.cast("timestamp_ntz"))


def canonical_text(utc: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS+00:00``; fractions are dropped."""
    return F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def standardize_text(col: Column | str) -> Column:
    """Canonical UTC text where parseable, otherwise the text as it was."""
    col = _col(col)
    return F.coalesce(canonical_text(parse_utc(col)), col)


def canonical_or_empty(col: Column | str) -> Column:
    """Canonical UTC text, or the empty string where missing or unparseable."""
    return F.coalesce(canonical_text(parse_utc(col)), F.lit(""))


def to_local(utc: Column | str, zone: str = NEW_YORK) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(utc))


def to_utc(local: Column, zone: str = NEW_YORK) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def local_date(utc: Column | str, zone: str = NEW_YORK) -> Column:
    return F.to_date(to_local(utc, zone))


def local_time(utc: Column | str, zone: str = NEW_YORK) -> Column:
    """Local time of day as ``HH:mm:ss`` text, which compares in time order."""
    return F.date_format(to_local(utc, zone), "HH:mm:ss")


def at_local_time(day: Column | str, hours: int, minutes: int, zone: str = NEW_YORK) -> Column:
    """The UTC wall time of a local clock time on a given date."""
    local = _col(day).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(hours), F.lit(minutes), F.lit(0)
    )
    return to_utc(local, zone)


def utc_date(col: Column | str) -> Column:
    """Calendar date of timestamp text in UTC, offset applied; NULL on junk."""
    return F.to_date(parse_utc(col))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_weekday(day: Column) -> Column:
    """Monday to Friday."""
    return F.weekday(day) < 5
