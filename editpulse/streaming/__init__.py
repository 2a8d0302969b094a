"""Structured Streaming pipelines over the shared operators."""

from .ingest import ingest_batch, ingest_stream, land_stream, rate_samples, store_stream
from .live import LiveWindows, live_stream, pane_stream, read_current, read_ticks, with_clock
from .metrics import metrics_stream, ProgressTable
from .recent import read_recent, recent_buffer, recent_stream
from .trending import sliding_count_stream, trending_stream

__all__ = [
    "rate_samples", "read_recent", "recent_buffer", "recent_stream",
    "LiveWindows", "live_stream", "pane_stream", "read_current", "read_ticks", "with_clock",
    "ingest_batch", "ingest_stream", "land_stream", "store_stream",
    "metrics_stream", "ProgressTable",
    "sliding_count_stream", "trending_stream",
]
