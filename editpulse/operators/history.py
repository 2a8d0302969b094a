"""Batch-layer aggregates over stored events.

``hour_rollup`` is the one wide aggregation; every table but the editor count
can be rebuilt from it, so a large history is scanned once. A hot article adds
at most one rollup row per hour, bot flag and namespace, whatever its volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULTS
from ..functions import bucket_offset_minutes, hour_start
from .filters import only_titles


def with_event_times(events: DataFrame, text_column: str | None = None) -> DataFrame:
    """Add ``edit_date`` and ``edit_hour``; with ``text_column`` also parse the timestamp first."""
    if text_column:
        events = events.withColumn("timestamp", F.try_to_timestamp(F.col(text_column)))
    return events.select(
        "*",
        F.to_date("timestamp").alias("edit_date"),
        hour_start(events, "timestamp").alias("edit_hour"),
    )


def hour_rollup(events: DataFrame) -> DataFrame:
    """Edits per (title, hour, bot, namespace)."""
    keyed = events.select("title", hour_start(events, "timestamp").alias("edit_hour"), "bot", "namespace")
    return keyed.groupBy("title", "edit_hour", "bot", "namespace").agg(F.count("*").alias("edits"))


def _edits(df: DataFrame) -> Column:
    """Weight of a row: a rollup row stands for ``edits`` events, an event for one."""
    return F.sum("edits") if "edits" in df.columns else F.count("*")


def _hour(df: DataFrame) -> Column:
    return F.col("edit_hour") if "edit_hour" in df.columns else hour_start(df, "timestamp")


def article_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("title").agg(_edits(df).alias("edit_count"))


def top_articles(df: DataFrame, limit: int = DEFAULTS.batch_top_n) -> DataFrame:
    return article_counts(df).orderBy(F.desc("edit_count"), "title").limit(limit)


def bot_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("bot").agg(_edits(df).alias("edit_count"))


def bot_vs_human(events: DataFrame) -> DataFrame:
    """One row; an unknown flag counts as human."""
    is_bot = F.coalesce(F.col("bot"), F.lit(False))
    return events.agg(F.count_if(is_bot).alias("bot"), F.count_if(~is_bot).alias("human"))


def namespace_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("namespace").agg(_edits(df).alias("edit_count"))


def namespace_ranking(df: DataFrame) -> DataFrame:
    return namespace_counts(df).orderBy(F.desc("edit_count"), "namespace")


def hourly_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(_hour(df).alias("edit_hour")).agg(_edits(df).alias("edit_count")).orderBy("edit_hour")


def article_hours(df: DataFrame) -> DataFrame:
    return df.groupBy("title", _hour(df).alias("edit_hour")).agg(_edits(df).alias("hourly_edits"))


def article_baseline(df: DataFrame) -> DataFrame:
    """Mean edits per hour over the hours in which an article was edited at all."""
    return article_hours(df).groupBy("title").agg(F.avg("hourly_edits").alias("baseline_edits_per_hour"))


def baseline_with_sums(df: DataFrame) -> DataFrame:
    """The baseline and the whole numbers it is the quotient of, for scores that are divided only once."""
    return article_hours(df).groupBy("title").agg(
        F.avg("hourly_edits").alias("baseline_edits_per_hour"),
        F.sum("hourly_edits").alias("baseline_edits"),
        F.count("hourly_edits").alias("baseline_hours"),
    )


def baseline_for(events: DataFrame, titles: DataFrame | Sequence[str], places: int = 4) -> DataFrame:
    """The baseline of the given titles: edits over active hours, rounded.

    Counts per (title, hour) come first, so no distinct set is held per title.
    A missing hour adds edits but is no active hour.
    """
    hours = article_hours(only_titles(events.select("title", "timestamp"), titles))
    active = F.greatest(F.count("edit_hour"), F.lit(1))
    mean = F.sum("hourly_edits").cast("double") / active
    return hours.groupBy("title").agg(F.round(mean, places).alias("baseline_edits_per_hour"))


def editors(events: DataFrame) -> DataFrame:
    return events.select("user").distinct()


def totals(df: DataFrame, editor_source: DataFrame | None = None) -> DataFrame:
    """One row with the number of events, articles and editors.

    Articles and editors are counted in two one-column passes rather than one
    pass with two distinct aggregates, which would triple the rows first.
    """
    by_title = article_counts(df).agg(
        F.coalesce(F.sum("edit_count"), F.lit(0)).alias("total_stored_events"),
        F.count("title").alias("total_articles"),
    )
    by_user = editors(df if editor_source is None else editor_source).agg(F.count("user").alias("total_editors"))
    return by_title.select("*", by_user.scalar().alias("total_editors"))


def edit_rate_buckets(
    events: DataFrame,
    minutes: int = DEFAULTS.bucket_minutes,
    limit: int = DEFAULTS.bucket_limit,
) -> DataFrame:
    """Edits per N-minute bucket: the newest ``limit`` buckets, oldest first."""
    if not 1 <= minutes <= 60:
        raise ValueError("minutes must lie between 1 and 60")
    if not 1 <= limit <= 500:
        raise ValueError("limit must lie between 1 and 500")
    window = F.window("timestamp", f"{minutes} minutes", startTime=f"{bucket_offset_minutes(minutes)} minutes")
    counts = events.groupBy(window.alias("w")).agg(F.count("*").alias("count"))
    newest = counts.select(F.col("w.start").alias("bucket"), "count").orderBy(F.desc("bucket")).limit(limit)
    return newest.orderBy("bucket")
