"""Writers. Every streaming write is keyed by its batch id, so a retry replaces it."""

from .commits import CommitLog
from .compact import compact_store, read_store
from .files import (
    append_metrics, overwrite_table, publish_snapshots, rewrite_landing, write_batch, write_rejects,
)
from .keyed import write_keyed

__all__ = [
    "CommitLog", "compact_store", "read_store", "append_metrics", "overwrite_table", "publish_snapshots", "rewrite_landing", "write_batch", "write_keyed", "write_rejects",
]
