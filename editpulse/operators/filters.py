"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULTS, Settings


def ingest_condition(settings: Settings = DEFAULTS, prefix: str = "") -> Column:
    """The ingestion filter as one predicate; null fields fail it."""
    tests = [
        F.col(f"{prefix}event_type") == settings.event_type,
        F.col(f"{prefix}namespace") == settings.namespace,
    ]
    if settings.exclude_bots:
        tests.append(~F.coalesce(F.col(f"{prefix}bot"), F.lit(False)))
    if settings.wiki:
        tests.append(F.col(f"{prefix}wiki") == settings.wiki)
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def ingest_filter(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return events.where(ingest_condition(settings))


def with_title(events: DataFrame) -> DataFrame:
    return events.where("title is not null and title <> ''")


def drop_if_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def drop_if_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna("all", subset=list(columns))


def positive_baseline(baseline: DataFrame) -> DataFrame:
    return baseline.where(F.col("title").isNotNull() & (F.col("baseline_edits_per_hour") > 0))


def only_titles(events: DataFrame, titles: DataFrame | Sequence[str]) -> DataFrame:
    """Events of the given titles, by a left-semi join; a list of any length is one."""
    if not isinstance(titles, DataFrame):
        titles = events.sparkSession.createDataFrame([(t,) for t in titles], "title string")
    return events.join(titles.select("title"), "title", "left_semi")
