"""Operational metrics of streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import DEFAULTS, Settings
from ..operators.rates import ingest_metrics
from ..schemas import METRIC
from ..sinks import write_batch
from .ingest import trigger


def metrics_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    seconds: float | None = DEFAULTS.metric_interval_seconds,
    ts: str = "timestamp",
) -> StreamingQuery:
    """Append the ingestion rate of every finished interval to the metrics table."""
    interval = F.window(ts, f"{settings.metric_interval_seconds} seconds").alias("w")
    counted = events.withWatermark(ts, settings.watermark_delay).groupBy(interval).agg(
        F.count("*").alias("events_published")
    )
    rates = counted.select(
        F.col("w.start").alias("interval_start"),
        "events_published",
        (F.col("events_published").cast("double") / float(settings.metric_interval_seconds)).alias("events_per_second"),
    )
    writer = (
        ingest_metrics(rates, settings.metric_namespace)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return trigger(writer, seconds).start()


class ProgressTable(StreamingQueryListener):
    """Append rows read, duration and late rows of every micro-batch to a metrics table.

    Spark keeps only the last reports of a query; this one is told of each. A
    micro-batch has a folder of its own, so none is counted twice. Add it with
    ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in report.stateOperators)
        values = (
            ("StreamInputRows", report.numInputRows, "Count"),
            ("StreamBatchDurationMs", report.batchDuration, "Milliseconds"),
            ("StreamLateRows", late, "Count"),
        )
        at = datetime.fromisoformat(report.timestamp.replace("Z", "+00:00"))
        samples = [(self.settings.metric_namespace, name, float(value), unit, at) for name, value, unit in values]
        rows = self.spark.createDataFrame(samples, METRIC).coalesce(1)
        write_batch(rows, f"{self.path}/query_id={report.id}/run_id={report.runId}", report.batchId)

    def onQueryTerminated(self, event) -> None:
        pass
