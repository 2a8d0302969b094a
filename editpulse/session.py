"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Session-level SQL settings every job of the engine relies on.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods beyond 8000 bytes; split generated code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Landing objects are single rows of up to the delivery size; bound a batch by bytes too.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app_name: str = "editpulse", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the engine's SQL settings."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a folder of
    its own, which is also recorded in the session so later calls agree.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("editpulse.shared.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="editpulse-")
    spark.conf.set("editpulse.shared.dir", folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder below the shared one for a single run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
