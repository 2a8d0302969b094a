"""The speed layer over stored events: the trailing window against the baseline."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULTS, Settings
from ..operators import live, trend, windows
from ..operators.filters import with_title
from ..functions import to_iso


def window_counts(
    events: DataFrame, window_seconds: int, anchor: Column | datetime | None = None
) -> DataFrame:
    recent = windows.trailing(events, window_seconds, anchor)
    return windows.title_counts(with_title(recent))


def trending_now(
    events: DataFrame,
    baseline: DataFrame | None,
    window_seconds: int = DEFAULTS.window_seconds,
    policy: trend.TrendPolicy = trend.RATE,
    settings: Settings = DEFAULTS,
    anchor: Column | datetime | None = None,
) -> DataFrame:
    """The ranked articles of the trailing window that ends at the anchor."""
    counts = window_counts(events, window_seconds, anchor)
    return trend.trending(counts, baseline, window_seconds, policy, settings)


def snapshot_now(
    events: DataFrame,
    baseline: DataFrame | None,
    window_seconds: int = DEFAULTS.window_seconds,
    policy: trend.TrendPolicy = trend.RATE,
    settings: Settings = DEFAULTS,
    anchor: Column | datetime | None = None,
    generated_at: Column | None = None,
) -> DataFrame:
    """The snapshot document of that window, as one row."""
    counts = window_counts(events, window_seconds, anchor)
    ranked = trend.trending(counts, baseline, window_seconds, policy, settings)
    stamp = to_iso(F.current_timestamp()) if generated_at is None else generated_at
    return live.snapshot(counts, ranked, window_seconds, stamp)


def trending_replay(
    events: DataFrame,
    baseline: DataFrame | None,
    window_seconds: int = DEFAULTS.window_seconds,
    slide_seconds: int = DEFAULTS.slide_seconds,
    policy: trend.TrendPolicy = trend.RATE,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The ranking of every sliding window of a stored history."""
    counts = windows.sliding_counts(
        with_title(events), window_seconds, slide_seconds, at_least=policy.least_edits(settings)
    )
    return trend.trending(counts, baseline, window_seconds, policy, settings, per=["window_start", "window_end"])
