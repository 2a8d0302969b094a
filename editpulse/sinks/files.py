"""File writers for batch tables, snapshots, metrics and repaired landing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def overwrite_table(frame: DataFrame, root: str, name: str, files: int | None = None) -> str:
    """Write a Parquet table; ``files`` merges a result of known small size into that many files."""
    path = f"{root.rstrip('/')}/{name}"
    (frame.coalesce(files) if files else frame).write.mode("overwrite").parquet(path)
    return path


def write_batch(frame: DataFrame, path: str, batch_id: int, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Write one micro-batch to a folder of its own, there by the given columns; writing it again replaces it."""
    writer = frame.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(f"{path.rstrip('/')}/batch_id={batch_id}")


def publish_snapshots(documents: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Keep the documents in the history of their batch and make the newest one the latest.

    Returns the stored documents, so what follows does not compute them again.
    """
    spark, root = documents.sparkSession, path.rstrip("/")
    history = f"{root}/history/batch_id={batch_id}"
    # By window, so that only the finished documents move, not the ranking behind them.
    documents.repartition("window_end").write.mode("overwrite").option("ignoreNullFields", "false").json(history)
    stored = spark.read.schema(documents.schema).json(history)
    newest = stored.orderBy(F.desc("window_end")).limit(1)
    newest.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/latest")
    return stored


def append_metrics(samples: DataFrame, path: str, batch_id: int) -> None:
    write_batch(samples.coalesce(1), path, batch_id)


def rewrite_landing(split: DataFrame, path: str) -> None:
    """One JSON value per line, in a new folder; the source objects stay as they are."""
    split.where("error is null").select("record").write.mode("errorifexists").text(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").parquet(path)
