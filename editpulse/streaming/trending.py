"""Sliding-window counts and trending snapshots on streams.

Windows are on event time. Counting goes through slide-wide panes: while a pane is
open the state holds one row per title and pane, and finished pane counts, not
events, are copied into the windows that contain them, which then hold one row per
title and open window.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..functions import to_iso
from ..operators import live, rates, trend
from ..operators.filters import with_title
from ..operators.windows import pane_sketches, united_sketches
from ..sinks import append_metrics, publish_snapshots
from .ingest import trigger


def sliding_count_stream(
    events: DataFrame,
    settings: Settings = DEFAULTS,
    ts: str = "timestamp",
) -> DataFrame:
    """Edits per title and sliding window, each window once and complete (append mode)."""
    timed = with_title(events.withWatermark(ts, settings.watermark_delay))
    pane = F.window(ts, f"{settings.slide_seconds} seconds").alias("pane")
    counted = timed.groupBy(pane, "title").agg(F.count("*").alias("edits"))
    wide = F.window(F.window_time("pane"), f"{settings.window_seconds} seconds", f"{settings.slide_seconds} seconds")
    return (
        counted.groupBy(wide.alias("w"), "title")
        .agg(F.sum("edits").alias("recent_edits"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "title",
            "recent_edits",
        )
    )


def distinct_stream(
    events: DataFrame, columns: Sequence[str], settings: Settings = DEFAULTS, ts: str = "timestamp"
) -> DataFrame:
    """Edits and estimated distinct values per sliding window, each window once (append mode).

    The state holds a sketch per column and open pane or window, whatever the traffic.
    """
    panes = pane_sketches(events.withWatermark(ts, settings.watermark_delay), columns, settings.slide_seconds, ts)
    wide = F.window(F.window_time("pane"), f"{settings.window_seconds} seconds", f"{settings.slide_seconds} seconds")
    return united_sketches(panes, columns, wide)


def trending_stream(
    events: DataFrame,
    baseline: DataFrame | Callable[[], DataFrame] | None,
    output: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    policy: trend.TrendPolicy = trend.RATE,
    seconds: float | None = DEFAULTS.trigger_seconds,
) -> StreamingQuery:
    """Rank every finished window and publish its snapshot document.

    Below ``output``: ``history`` (one document per window, by batch), ``latest``
    (the newest document) and ``metrics``. A baseline given as a callable is read
    again for each micro-batch. A batch without a finished window publishes
    nothing: an unfinished window is not an empty one.
    """
    root = output.rstrip("/")

    def publish(batch: DataFrame, batch_id: int) -> None:
        started = time.perf_counter()
        spark = batch.sparkSession
        counts = batch.persist()
        try:
            # The one run of the stateful plan; what follows reads its result.
            if counts.count() == 0:
                return
            known = baseline() if callable(baseline) else baseline
            per = ["window_start", "window_end"]
            ranked = trend.trending(counts, known, settings.window_seconds, policy, settings, per=per)
            documents = live.snapshots(counts, ranked, settings.window_seconds, to_iso(F.current_timestamp()), per)
            stored = publish_snapshots(documents, root, batch_id)
            latency = (time.perf_counter() - started) * 1000.0
            samples = rates.snapshot_metrics(stored, F.col("window_end"), settings.metric_namespace)
            timing = rates.metric_rows(
                spark.range(1),
                {rates.PROCESSING_LATENCY[0]: (F.lit(latency), rates.PROCESSING_LATENCY[1])},
                F.current_timestamp(),
                settings.metric_namespace,
            )
            append_metrics(samples.unionByName(timing), f"{root}/metrics", batch_id)
        finally:
            counts.unpersist()

    counts = sliding_count_stream(events, settings)
    writer = (
        counts.writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", checkpoint)
    )
    return trigger(writer, seconds).start()
