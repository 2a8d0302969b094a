"""Readers for stored tables, raw landing files and streams."""

from .landing import read_landing, split_landing, split_large
from .probe import StoredBaseline, store_baseline
from .streams import read_stream, with_arrival_time
from .tables import (
    empty_baseline, read_baseline, read_event_json, read_events, read_parts, read_snapshot, read_snapshots, union_parts,
)

__all__ = [
    "read_landing", "split_landing", "split_large",
    "StoredBaseline", "store_baseline",
    "read_stream", "with_arrival_time",
    "empty_baseline", "read_baseline", "read_event_json", "read_events", "read_parts", "read_snapshot", "read_snapshots", "union_parts",
]
