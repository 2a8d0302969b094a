"""Defaults of the engine in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed values, but for the watermark delay: the defaults users of the pipeline rely on."""

    # speed layer
    window_seconds: int = 300
    view_window_seconds: int = 600
    slide_seconds: int = 10
    trigger_seconds: int = 5
    watermark_delay: str = "1 minute"

    # ranking
    min_edits: int = 3
    fallback_min_edits: int = 1
    score_threshold: float = 0.5
    baseline_floor: float = 0.5
    trending_top_n: int = 10

    # batch layer
    batch_top_n: int = 50
    summary_top_n: int = 10
    bucket_minutes: int = 5
    bucket_limit: int = 48

    # ingestion filter; an empty ``wiki`` switches that test off
    event_type: str = "edit"
    namespace: int = 0
    exclude_bots: bool = True
    wiki: str = "enwiki"

    # sinks and views
    store_flush_seconds: int = 2
    recent_events: int = 200
    metric_interval_seconds: int = 10
    metric_namespace: str = "EditPulse"


DEFAULTS = Settings()
