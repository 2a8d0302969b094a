"""The batch layer: six tables from the event history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULTS, Settings
from ..operators import history
from ..session import run_folder
from ..sinks import overwrite_table


def batch_tables(rollup: DataFrame, editor_source: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """All six tables, from the hourly rollup and a frame with the ``user`` column."""
    return {
        "top_articles": history.top_articles(rollup, settings.batch_top_n),
        "bot_vs_human": history.bot_counts(rollup),
        "namespace_breakdown": history.namespace_counts(rollup),
        "edit_rate_hourly": history.hourly_counts(rollup),
        "article_baseline": history.article_baseline(rollup),
        "summary": history.totals(rollup, editor_source),
    }


def run_batch_layer(
    spark: SparkSession,
    events: DataFrame,
    output: str,
    settings: Settings = DEFAULTS,
    columnar_input: bool = True,
) -> dict[str, str]:
    """Write the six tables below ``output``; returns their paths.

    The history is aggregated once into the hourly rollup, which is written to
    the shared folder: a lost executor costs a re-read, not a re-scan. Text
    input is first rewritten as the few columns needed, so it is parsed once.
    """
    work = run_folder(spark, "batch-layer")
    events = events.select("title", "user", "bot", "namespace", "timestamp")
    if not columnar_input:
        events.write.parquet(f"{work}/events")
        events = spark.read.parquet(f"{work}/events")
    history.hour_rollup(events).write.parquet(f"{work}/rollup")
    tables = batch_tables(spark.read.parquet(f"{work}/rollup"), events, settings)

    # The baseline has a row per article; the others are small by construction.
    return {
        name: overwrite_table(table, output, name, None if name == "article_baseline" else 1)
        for name, table in tables.items()
    }
