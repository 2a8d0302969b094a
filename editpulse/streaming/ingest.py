"""Ingestion: raw records to the event store, the bus and the landing zone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..config import DEFAULTS, Settings
from ..operators.display import bus_rows, event_row
from ..operators.filters import ingest_condition, ingest_filter
from ..operators.normalise import accepted, counter_columns, normalise, rejected
from ..operators.rates import ingest_metrics, ingest_rate, metric_rows
from ..sinks import CommitLog, append_metrics, write_batch, write_keyed


def trigger(writer: DataStreamWriter, seconds: float | None) -> DataStreamWriter:
    """A fixed cadence, or with ``None`` all data available now and then stop."""
    if seconds is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{seconds} seconds")


def store_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    seconds: float | None = DEFAULTS.store_flush_seconds,
) -> StreamingQuery:
    """Append events to the store, by date; the file sink's log makes each row appear once."""
    dated = event_row(events).withColumn("event_date", F.to_date("timestamp"))
    writer = (
        dated.writeStream.format("parquet")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return trigger(writer, seconds).start()


def land_stream(
    records: DataFrame,
    path: str,
    checkpoint: str,
    seconds: float | None = DEFAULTS.store_flush_seconds,
    ts: str = "arrived_at",
    value: str = "value",
) -> StreamingQuery:
    """Land raw records by date and hour of arrival, one record per line."""
    placed = records.select(
        F.date_format(ts, "yyyy-MM-dd").alias("event_date"), F.date_format(ts, "HH").alias("event_hour"), value
    )
    writer = (
        placed.writeStream.format("text")
        .partitionBy("event_date", "event_hour")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return trigger(writer, seconds).start()


def ingest_batch(raw: DataFrame, settings: Settings = DEFAULTS, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Accepted events after the ingestion filter, and the rejected records."""
    checked = normalise(raw, value)
    return ingest_filter(accepted(checked), settings), rejected(checked)


def ingest_stream(
    raw: DataFrame,
    output: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    seconds: float | None = DEFAULTS.trigger_seconds,
    value: str = "value",
    consumers: Sequence[Callable[[DataFrame, int], None]] = (),
) -> StreamingQuery:
    """Parse, filter and fan out one stream to events, bus rows, rejects and counters.

    Further ``consumers`` are given the stored events of a micro-batch and its id.

    A micro-batch is normalised once and written once, to a folder of its own;
    the consumers are cut from that written batch, so a lost executor or a retry
    neither repeats the parsing for each consumer nor duplicates a row. The copy
    goes when they are done. Events lie by batch and date, so that readers of a
    trailing window open its dates only; bus rows carry a sequence per key.
    """
    root = output.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        write_batch(normalise(batch.select(value), value), f"{root}/normalised", batch_id)
        checked = spark.read.parquet(f"{root}/normalised/batch_id={batch_id}")
        events = ingest_filter(accepted(checked), settings)
        write_batch(events.withColumn("event_date", F.to_date("timestamp")), f"{root}/events", batch_id, by=["event_date"])
        write_keyed(bus_rows(events, ["timestamp"]), f"{root}/bus", batch_id, ["timestamp", "value"])
        write_batch(rejected(checked), f"{root}/rejects", batch_id)
        counters = checked.agg(*counter_columns(settings))
        names = ("total_received", "total_accepted", "total_filtered", "total_parse_errors")
        samples = metric_rows(
            counters, {n: (F.col(n), "Count") for n in names}, F.current_timestamp(), settings.metric_namespace
        )
        append_metrics(samples, f"{root}/metrics", batch_id)
        stored = event_row(spark.read.parquet(f"{root}/events/batch_id={batch_id}")) if consumers and not events.isEmpty() else None
        for consume in consumers if stored is not None else ():
            consume(stored, batch_id)
        CommitLog(spark, root).drop(f"{root}/normalised/batch_id={batch_id}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return trigger(writer, seconds).start()


def rate_samples(path: str, settings: Settings = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """A consumer that writes the ingestion rate of each micro-batch by interval.

    An interval that several micro-batches reach has a sample in each; they add up.
    """

    def write(events: DataFrame, batch_id: int) -> None:
        counted = ingest_rate(events, settings.metric_interval_seconds)
        append_metrics(ingest_metrics(counted, settings.metric_namespace), path, batch_id)

    return write


def observed(normalised: DataFrame, settings: Settings = DEFAULTS, name: str = "ingest") -> DataFrame:
    """Pass rows through and report the pipeline counters with each micro-batch's progress."""
    return normalised.observe(name, *counter_columns(settings))


__all__ = [
    "ingest_batch", "ingest_condition", "ingest_stream", "land_stream", "observed", "rate_samples", "store_stream", "trigger",
]
