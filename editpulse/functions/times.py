"""Timestamp helpers. Results do not depend on the session time zone unless noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import strip

# The epoch seconds of years 1 and 9999, the range a calendar date can hold.
FIRST_EPOCH_SECOND = -62135596800
LAST_EPOCH_SECOND = 253402300799

# Minutes from 1970-01-01 to 2000-01-03, the origin used for N-minute buckets.
BUCKET_ORIGIN_MINUTES = 15780960

_NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_CLOCK = r"[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?"
_ZONE = r"(?:Z|[+-][0-9]{2}(?::?[0-9]{2}(?::[0-9]{2})?)?)"
_CLOCK_AT_END = r"([T ][0-9:.]+)\z"
_ISO = rf"\A{_DATE}(?:{_CLOCK}{_ZONE}?)?\z"


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds (double) to a timestamp with microseconds; null when out of the calendar."""
    in_range = seconds.between(float(FIRST_EPOCH_SECOND), float(LAST_EPOCH_SECOND))
    return F.when(in_range, F.timestamp_micros(F.bround(seconds * F.lit(1e6)).cast("long")))


def iso_to_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp; a clock time without a zone is taken as UTC.

    A date alone starts at midnight of the session time zone, which the engine pins to UTC.
    """
    iso = F.translate(F.regexp_extract(text, _ISO, 0), ",", ".")
    return F.try_to_timestamp(F.regexp_replace(iso, _CLOCK_AT_END, "$1Z"))


def numeric_text(text: Column) -> Column:
    """Decimal text as double; null for any other text."""
    return F.regexp_extract(strip(text), _NUMBER, 0).try_cast("double")


def parse_timestamp(text: Column) -> Column:
    """Numeric text as epoch seconds, other text as ISO-8601; null when neither fits."""
    return F.coalesce(epoch_to_timestamp(numeric_text(text)), iso_to_timestamp(text))


def to_iso(ts: Column) -> Column:
    """UTC ISO-8601 text with ``+00:00``; the fraction is left out when it is zero.

    Formats in the session time zone, which the engine pins to UTC.
    """
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(ts.cast("timestamp")) % 1000000 == 0, whole).otherwise(fraction)


def hour_start(df: DataFrame, column: str) -> Column:
    """Start of the hour, in the type of the column (``date_trunc`` alone drops ``timestamp_ntz``)."""
    return F.date_trunc("hour", F.col(column)).cast(df.schema[column].dataType)


def bucket_offset_minutes(minutes: int) -> int:
    """Shift that makes N-minute windows start where the bucket origin puts them."""
    return BUCKET_ORIGIN_MINUTES % minutes
