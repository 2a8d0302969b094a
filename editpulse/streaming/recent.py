"""The newest events of a stream, kept in a buffer of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS
from ..operators.display import recent_events
from ..schemas import EVENT
from ..sinks import CommitLog, write_batch
from .ingest import trigger


def recent_buffer(output: str, keep: int = DEFAULTS.recent_events, tie: Sequence[str] = ("title", "user")) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does to the buffer of the newest ``keep`` events below ``output``.

    The batch is cut to its newest events before they meet the buffer, and the new
    buffer takes the place of the old one by a record, so readers find the one or
    the other and a retry starts from the buffer before its batch.
    """
    root = output.rstrip("/")
    newest = [F.desc("timestamp"), *[F.desc(c) for c in tie]]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, f"{root}/commits")
        last = log.latest(below=batch_id)
        rows = batch.orderBy(*newest).limit(keep)
        if last:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/{last[1]['buffer']}")).orderBy(*newest).limit(keep)
        write_batch(rows.coalesce(1), f"{root}/buffer", batch_id)
        log.put(batch_id, {"buffer": f"buffer/batch_id={batch_id}"})
        for old in log.numbers():
            if last and old < last[0]:
                log.drop(f"{root}/buffer/batch_id={old}")
        log.forget(last[0] if last else 0)

    return merge


def recent_stream(
    events: DataFrame,
    output: str,
    checkpoint: str,
    keep: int = DEFAULTS.recent_events,
    seconds: float | None = DEFAULTS.trigger_seconds,
    tie: Sequence[str] = ("title", "user"),
) -> StreamingQuery:
    """Keep the newest ``keep`` events by time below ``output``."""
    writer = events.writeStream.foreachBatch(recent_buffer(output, keep, tie)).option("checkpointLocation", checkpoint)
    return trigger(writer, seconds).start()


def read_recent(spark: SparkSession, output: str, n: int = 50, tie: Sequence[str] = ("title", "user"), keep: int = DEFAULTS.recent_events) -> DataFrame:
    """The newest ``n`` events of the buffer, newest first; none before the first micro-batch."""
    last = CommitLog(spark, f"{output.rstrip('/')}/commits").latest()
    if last is None:
        return recent_events(spark.createDataFrame([], EVENT), n, keep=keep)
    return recent_events(spark.read.parquet(f"{output.rstrip('/')}/{last[1]['buffer']}"), n, tie, keep)
