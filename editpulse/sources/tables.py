"""Batch readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import parse_timestamp
from ..schemas import BASELINE, EVENT, SNAPSHOT, WINDOW_SNAPSHOT, WIRE_EVENT

# Error conditions that mean "nothing is stored there yet".
_NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() in _NOTHING_THERE


def read_event_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines of normalised events anywhere below a folder (or in a list of files), with a typed timestamp."""
    lines = spark.read.schema(WIRE_EVENT).option("recursiveFileLookup", "true").json(path)
    return lines.withColumn("timestamp", parse_timestamp(F.col("timestamp")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored event table; its ``event_date`` partitions stay available for pruning."""
    return spark.read.parquet(path)


def empty_baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BASELINE)


def read_baseline(spark: SparkSession, path: str | None, positive_only: bool = True) -> DataFrame:
    """Title and baseline without nulls; an empty frame when no baseline has been written yet.

    Only a missing path is tolerated. Any other failure is an error of the job.
    """
    if not path:
        return empty_baseline(spark)
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if _is_missing(error):
            return empty_baseline(spark)
        raise
    usable = table.select("title", F.col("baseline_edits_per_hour").cast("double")).dropna()
    return usable.where("baseline_edits_per_hour > 0") if positive_only else usable


def read_parts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All Parquet files below a folder; empty with the given schema when there are none."""
    reader = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if _is_missing(error):
            return spark.createDataFrame([], schema)
        raise


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, matched by column name; a column missing in a part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot document; no row when none has been published."""
    try:
        return spark.read.schema(SNAPSHOT).json(f"{path.rstrip('/')}/latest")
    except AnalysisException as error:
        if _is_missing(error):
            return spark.createDataFrame([], SNAPSHOT)
        raise


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All published documents, one per window."""
    return spark.read.schema(WINDOW_SNAPSHOT).json(f"{path.rstrip('/')}/history").drop("batch_id")


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def create_event_table(spark: SparkSession, name: str, path: str) -> None:
    """Create the event table over a folder unless it exists, and register the dates stored there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT.fields)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, event_date DATE) "
        f"USING parquet PARTITIONED BY (event_date) LOCATION '{path}'"
    )
    register_dates(spark, name)


def register_dates(spark: SparkSession, name: str) -> None:
    """Let the event table see the dates and files that were stored since.

    A table made over a folder that a stream has written to goes by the stream's
    log; its dates are not in the catalogue and need no registering.
    """
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"MSCK REPAIR TABLE {name} ADD PARTITIONS")
    spark.catalog.refreshTable(name)
