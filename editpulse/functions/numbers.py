"""Rates, ratios and scores, all in double arithmetic."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, functions as F

FALLBACK_WINDOW_SECONDS = 300


def hourly_rate(n: Column, window_seconds: int) -> Column:
    """Edits per hour when ``n`` edits fall in a window of that many seconds."""
    seconds = window_seconds if window_seconds > 0 else FALLBACK_WINDOW_SECONDS
    return n.cast("double") * F.lit(3600.0 / float(seconds))


def speed_score(rate: Column, baseline: Column) -> Column:
    """How many times its usual hourly rate an article is edited now; null without a baseline."""
    return F.when(baseline > 0, rate / baseline)


def speed_score_of_sums(n: Column, window_seconds: int, edits: Column, hours: Column) -> Column:
    """The speed score against a baseline of ``edits`` in ``hours``, divided once, so it is the double nearest to it.

    After three divisions a score of 1.475 can be 1.4749999999999999 and rounds down.
    """
    seconds = window_seconds if window_seconds > 0 else FALLBACK_WINDOW_SECONDS
    per_hour = Fraction(3600) / Fraction(seconds)
    above = n.cast("double") * hours.cast("double") * F.lit(float(per_hour.numerator))
    return F.when(edits > 0, above / (edits.cast("double") * F.lit(float(per_hour.denominator))))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, and 0.0 where the divisor is zero or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def share(a: Column, b: Column, places: int = 4) -> Column:
    return F.round(safe_ratio(a, b), places)
