"""Stream readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_stream(
    spark: SparkSession,
    path: str | None = None,
    schema: StructType | None = None,
    source: str = "parquet",
    per_trigger: int | None = None,
    newest_first: bool = False,
    **options: str,
) -> DataFrame:
    """A streaming frame over a folder or, with ``source="kafka"`` or ``"kinesis"``, over a bus.

    ``per_trigger`` bounds one micro-batch: files for a folder, offsets for
    Kafka. Positions live in the checkpoint of the query, so a restart leaves
    no gap. Bus connectors need their jar on the class path.
    """
    reader = spark.readStream.format(source).options(**options)
    if source == "kafka":
        reader = reader.option("startingOffsets", options.get("startingOffsets", "latest"))
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", str(per_trigger))
    elif path is not None:
        reader = reader.option("latestFirst", str(newest_first).lower())
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(per_trigger))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def with_arrival_time(records: DataFrame, column: str = "timestamp") -> DataFrame:
    """Stamp records with the time of the micro-batch that reads them."""
    return records.withColumn(column, F.current_timestamp())
