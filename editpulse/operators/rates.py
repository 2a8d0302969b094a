"""Ingestion rates and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULTS


def ingest_rate(
    events: DataFrame,
    interval_seconds: int = DEFAULTS.metric_interval_seconds,
    ts: str = "timestamp",
) -> DataFrame:
    """Events and events per second for each interval in which something arrived."""
    counts = events.groupBy(F.window(ts, f"{interval_seconds} seconds").alias("w")).agg(
        F.count("*").alias("events_published")
    )
    return counts.select(
        F.col("w.start").alias("interval_start"),
        "events_published",
        (F.col("events_published").cast("double") / float(interval_seconds)).alias("events_per_second"),
    )


def rate_rollup(
    rates: DataFrame,
    minutes: int = DEFAULTS.bucket_minutes,
    interval_seconds: int = DEFAULTS.metric_interval_seconds,
) -> DataFrame:
    """Average and maximum rate per N minutes.

    The average is taken as whole events over whole seconds, so it does not
    depend on the order in which rates would be added up.
    """
    seconds = F.count("*") * F.lit(interval_seconds)
    return (
        rates.groupBy(F.window("interval_start", f"{minutes} minutes").alias("w"))
        .agg(
            (F.sum("events_published").cast("double") / seconds).alias("average_eps"),
            F.max("events_per_second").alias("maximum_eps"),
        )
        .select(F.col("w.start").alias("bucket"), "average_eps", "maximum_eps")
    )


def speedup(runs: DataFrame, size: str = "executors", runtime: str = "runtime_seconds") -> DataFrame:
    """Runtime at the smallest size divided by each runtime."""
    base = runs.agg(F.min_by(runtime, size)).scalar()
    return runs.select("*", F.try_divide(base, F.col(runtime)).alias("speedup"))


def metric_rows(frame: DataFrame, metrics: dict[str, tuple[Column, str]], ts: Column, namespace: str) -> DataFrame:
    """Turn columns into metric samples: one row per input row and metric name."""
    samples = [
        F.struct(
            F.lit(namespace).alias("namespace"),
            F.lit(name).alias("metric_name"),
            value.cast("double").alias("value"),
            F.lit(unit).alias("unit"),
            ts.alias("ts"),
        )
        for name, (value, unit) in metrics.items()
    ]
    return frame.select(F.inline(F.array(*samples)))


# The metric names and units that monitoring expects.
EVENTS_PER_SECOND = ("IngestionEventsPerSecond", "Count/Second")
EVENTS_PUBLISHED = ("IngestionEventsPublished", "Count")
WINDOW_EVENTS = ("SpeedLayerWindowEvents", "Count")
TRENDING_COUNT = ("SpeedLayerTrendingArticleCount", "Count")
PROCESSING_LATENCY = ("SpeedLayerProcessingLatencyMs", "Milliseconds")


def ingest_metrics(rates: DataFrame, namespace: str = DEFAULTS.metric_namespace) -> DataFrame:
    return metric_rows(
        rates,
        {
            EVENTS_PER_SECOND[0]: (F.col("events_per_second"), EVENTS_PER_SECOND[1]),
            EVENTS_PUBLISHED[0]: (F.col("events_published"), EVENTS_PUBLISHED[1]),
        },
        F.col("interval_start"),
        namespace,
    )


def snapshot_metrics(snapshots: DataFrame, ts: Column, namespace: str = DEFAULTS.metric_namespace) -> DataFrame:
    return metric_rows(
        snapshots,
        {
            WINDOW_EVENTS[0]: (F.col("total_events_in_window"), WINDOW_EVENTS[1]),
            TRENDING_COUNT[0]: (F.size("trending_articles"), TRENDING_COUNT[1]),
        },
        ts,
        namespace,
    )
