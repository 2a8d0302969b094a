"""Projections that shape stored and live rows for readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULTS
from ..functions import fill_text, null_if_empty, to_iso
from ..schemas import EVENT, TRENDING_ROW
from .filters import drop_if_any_null

# The columns of the event views and the texts of the combined view.
RECENT_COLUMNS = ("timestamp", "title", "user", "anonymous", "bot", "comment", "namespace", "wiki", "server_name")
STREAM_COLUMNS = ("timestamp", "title", "user", "anonymous", "comment")

NO_BASELINE_TEXT = "No historical data"
NO_SCORE_TEXT = "N/A"

# Fixed value: the longest key the bus takes.
MAX_KEY_LENGTH = 256


def event_row(events: DataFrame) -> DataFrame:
    return events.select(*EVENT.fieldNames())


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def present_columns(df: DataFrame, columns: Sequence[str] = STREAM_COLUMNS) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def bus_rows(events: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Key and JSON payload of each event, ready for a keyed sink, and columns carried along."""
    key = F.left(F.coalesce(null_if_empty(F.col("title")), F.lit("unknown")), F.lit(MAX_KEY_LENGTH))
    fields = [to_iso(F.col("timestamp")).alias("timestamp")]
    fields += [F.col(name) for name in EVENT.fieldNames()[1:]]
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return events.select(key.alias("key"), payload.alias("value"), *carried)


def recent_events(
    events: DataFrame,
    n: int = 50,
    tie: Sequence[str] = ("title", "user"),
    keep: int = DEFAULTS.recent_events,
) -> DataFrame:
    """The newest ``n`` events, newest first; ``n`` lies between 1 and ``keep``."""
    if not 1 <= n <= keep:
        raise ValueError(f"n must be between 1 and {keep}")
    newest = events.orderBy(F.desc("timestamp"), *[F.desc(c) for c in tie]).limit(n)
    return newest.select(to_iso(F.col("timestamp")).alias("timestamp"), *RECENT_COLUMNS[1:])


def number(c: Column) -> Column:
    """Any value as double; null where it is no number."""
    return c.try_cast("double")


def display_trending(rows: DataFrame) -> DataFrame:
    """The combined view of live rate and baseline, as texts a table can show."""
    require_columns(rows, TRENDING_ROW.fieldNames())
    ordered = rows.orderBy(
        F.desc("baseline_available"),
        F.desc_nulls_last("trend_score"),
        F.desc("current_edits_per_hour"),
        "title",
    )
    return ordered.select(
        F.col("title").alias("Article"),
        F.col("recent_edits").alias("Recent Edits"),
        F.round(number(F.col("current_edits_per_hour")), 1).alias("Current Edits/Hour"),
        fill_text(F.col("baseline_edits_per_hour"), "%.2f", NO_BASELINE_TEXT).alias("Historical Baseline/Hour"),
        fill_text(F.col("trend_score"), "%.2f×", NO_SCORE_TEXT).alias("Trend vs Baseline"),
    )


def display_top_articles(top: DataFrame, limit: int = 10) -> DataFrame:
    usable = drop_if_any_null(require_columns(top, ["title", "edit_count"]), ["title", "edit_count"])
    return usable.orderBy(F.desc("edit_count"), "title").limit(limit)


def display_baseline(baseline: DataFrame, limit: int = 10) -> DataFrame:
    names = ["title", "baseline_edits_per_hour"]
    usable = drop_if_any_null(require_columns(baseline, names).select(*names), names)
    best = usable.orderBy(F.desc("baseline_edits_per_hour"), "title").limit(limit)
    return best.select(
        F.col("title").alias("Article"),
        F.round(number(F.col("baseline_edits_per_hour")), 2).alias("Historical Edits/Hour"),
    )


def bars(rows: DataFrame, value: str, label: str = "title") -> DataFrame:
    """Ascending order, as horizontal bar charts want it."""
    return rows.orderBy(F.asc(value), label)


def window_minutes(seconds: int | None) -> float:
    return seconds / 60 if seconds else 5.0
