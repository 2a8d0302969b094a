"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def fill_text(c: Column, pattern: str, missing: str) -> Column:
    """Format a number as text, with a fixed text in place of null."""
    return F.when(c.isNotNull(), F.format_string(pattern, c)).otherwise(F.lit(missing))
