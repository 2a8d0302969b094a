"""The views a reader of the engine asks for."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULTS, Settings
from ..operators import display, history, live, trend, windows
from ..operators.filters import drop_if_all_null, only_titles
from ..operators.normalise import counter_columns, with_drop_rate
from ..sources.tables import read_parts, register_tables
from ..schemas import BASELINE
from .speed_layer import trending_now

SUMMARY_COLUMNS = ("total_stored_events", "total_articles", "total_editors")


def current_baseline(events: DataFrame, window_seconds: int, anchor: Column | None = None) -> DataFrame:
    """The baseline of just the titles in the current window, from all stored events."""
    current = windows.trailing(events, window_seconds, anchor).select("title").distinct()
    return history.baseline_for(events, current)


def trending_view(
    events: DataFrame,
    baseline: DataFrame | None = None,
    window_seconds: int = DEFAULTS.view_window_seconds,
    settings: Settings = DEFAULTS,
    anchor: Column | None = None,
) -> DataFrame:
    """Trending articles; without a given baseline it is computed from the stored events."""
    known = current_baseline(events, window_seconds, anchor) if baseline is None else baseline
    return trending_now(events, known, window_seconds, trend.RATIO, settings, anchor)


def live_view(
    events: DataFrame,
    baseline: DataFrame | None = None,
    window_seconds: int = DEFAULTS.view_window_seconds,
    settings: Settings = DEFAULTS,
    anchor: Column | None = None,
    generated_at: Column | None = None,
) -> DataFrame:
    metrics = live.live_metrics(windows.trailing(events, window_seconds, anchor), window_seconds)
    ranked = trending_view(events, baseline, window_seconds, settings, anchor)
    return live.live_document(metrics, ranked, F.current_timestamp() if generated_at is None else generated_at)


def _as_list(rows: DataFrame, order: Sequence[Column]) -> Column:
    """Few rows as one array column in a given order, as a scalar subquery."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    entries = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*rows.columns).alias("row"))))
    return rows.agg(F.transform(entries, lambda e: e["row"]).alias("rows")).scalar()


def history_view(
    events: DataFrame,
    minutes: int = DEFAULTS.bucket_minutes,
    limit: int = DEFAULTS.bucket_limit,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row: totals, bot share, namespaces, top articles and the newest edit-rate buckets."""
    by_most = [-F.col("edit_count")]
    split = history.bot_vs_human(events)
    return history.totals(events).select(
        "*",
        split.select(F.struct("bot", "human")).scalar().alias("bot_vs_human"),
        _as_list(history.namespace_counts(events), [*by_most, F.col("namespace")]).alias("namespace_breakdown"),
        _as_list(history.top_articles(events, settings.summary_top_n), [*by_most, F.col("title")]).alias("top_edited_articles"),
        _as_list(history.edit_rate_buckets(events, minutes, limit), [F.col("bucket")]).alias("edit_rate_history"),
    )


def recent_view(events: DataFrame, n: int = 50, settings: Settings = DEFAULTS) -> DataFrame:
    return display.recent_events(events, n, keep=settings.recent_events)


def health_view(
    normalised: DataFrame,
    window_seconds: int = DEFAULTS.view_window_seconds,
    settings: Settings = DEFAULTS,
    now: Column | None = None,
) -> DataFrame:
    """Pipeline counters, events in the trailing window and seconds since the last accepted event."""
    from ..operators.filters import ingest_condition

    at = F.current_timestamp() if now is None else now
    ts = F.col("event.timestamp")
    good = F.col("reject_reason").isNull() & ingest_condition(settings, prefix="event.")
    in_window = good & (ts >= at - windows.seconds_interval(window_seconds)) & (ts <= at)
    # One aggregation, so that the records are parsed once.
    counted = normalised.agg(
        *counter_columns(settings),
        F.count_if(in_window).alias("events_in_window"),
        F.max(F.when(good, ts)).alias("last_event_at"),
    )
    idle = (F.unix_micros(at) - F.unix_micros("last_event_at")).cast("double") / 1e6
    return with_drop_rate(counted).select(
        "total_received", "total_accepted", "total_filtered", "total_parse_errors", "drop_rate", "reject_share",
        F.lit(window_seconds).alias("window_size_seconds"),
        "events_in_window",
        F.round(idle, 2).alias("seconds_since_last_event"),
    )


def combined_view(snapshot: DataFrame) -> DataFrame:
    """The display table of a snapshot document."""
    return display.display_trending(snapshot.select(F.inline("trending_articles")))


def summary_row(summary: DataFrame) -> DataFrame:
    names = [c for c in SUMMARY_COLUMNS if c in summary.columns]
    return drop_if_all_null(summary, names).limit(1) if names else summary.limit(1)


def stored_views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Summary row, top articles and top baselines from the stored batch tables."""
    root = root.rstrip("/")
    summary = read_parts(spark, f"{root}/summary", _longs(*SUMMARY_COLUMNS))
    top = read_parts(spark, f"{root}/top_articles", _top_schema())
    baseline = read_parts(spark, f"{root}/article_baseline", BASELINE)
    return {
        "summary": summary_row(summary),
        "top_articles": display.display_top_articles(top),
        "article_baseline": display.display_baseline(baseline),
    }


def _longs(*names: str):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([StructField(n, LongType()) for n in names])


def _top_schema():
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return StructType([StructField("title", StringType()), StructField("edit_count", LongType())])


def query(spark: SparkSession, sql: str, params: Sequence[Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Ad-hoc SQL with positional ``?`` parameters over named tables."""
    register_tables(spark, tables)
    return spark.sql(sql, args=list(params)) if params else spark.sql(sql)
