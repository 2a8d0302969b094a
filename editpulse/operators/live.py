"""One-row summaries of the current window, and the nested documents built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import share


def live_metrics(window_events: DataFrame, window_seconds: int) -> DataFrame:
    """Totals of a trailing window; an empty window gives zeros.

    Editors and articles are counted in passes over one column each: two distinct
    counts in one aggregation would copy every event.
    """
    total = F.count("*")
    flagged = F.count_if(F.coalesce(F.col("anonymous"), F.lit(False)))
    sums = window_events.agg(
        total.alias("total_events"),
        share(flagged, total).alias("anonymous_ratio"),
        F.round(total.cast("double") / F.lit(float(window_seconds)), 4).alias("events_per_second"),
    )
    return sums.select(
        F.lit(window_seconds).alias("window_size"),
        "total_events",
        _distinct(window_events, "user").alias("unique_editors"),
        _distinct(window_events, "title").alias("active_articles"),
        "anonymous_ratio",
        "events_per_second",
    )


def _distinct(rows: DataFrame, column: str) -> Column:
    return rows.select(column).distinct().agg(F.count(column)).scalar()


def window_totals(counts: DataFrame) -> DataFrame:
    """Events and distinct articles of a window, from its per-title counts."""
    return counts.agg(
        F.coalesce(F.sum("recent_edits"), F.lit(0)).alias("total_events_in_window"),
        F.count("title").alias("distinct_articles_in_window"),
    )


def ranked_list(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """Ranked rows (at most the top-N) as one array in rank order."""
    return ranked.agg(_in_rank_order(columns).alias("trending_articles"))


def _in_rank_order(columns: list[str]) -> Column:
    entries = F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("row"))))
    return F.transform(entries, lambda e: e["row"])


def row_columns(ranked: DataFrame) -> list[str]:
    return [c for c in ranked.columns if c not in ("rank", "window_start", "window_end")]


def snapshot(
    counts: DataFrame,
    ranked: DataFrame,
    window_seconds: int,
    generated_at: Column,
) -> DataFrame:
    """The speed-layer document: one row with the totals and the ranked articles nested."""
    return window_totals(counts).select(
        generated_at.alias("generated_at"),
        F.lit(window_seconds).alias("window_seconds"),
        "total_events_in_window",
        "distinct_articles_in_window",
        ranked_list(ranked, row_columns(ranked)).scalar().alias("trending_articles"),
    )


def snapshots(
    counts: DataFrame,
    ranked: DataFrame,
    window_seconds: int,
    generated_at: Column,
    per: Sequence[str] = ("window_start", "window_end"),
) -> DataFrame:
    """The document of every window at once: totals by window, joined to its ranked articles."""
    keys = list(per)
    totals = counts.groupBy(*keys).agg(
        F.sum("recent_edits").alias("total_events_in_window"),
        F.count("title").alias("distinct_articles_in_window"),
    )
    row_type = ranked.select(F.array(F.struct(*row_columns(ranked))).alias("a")).schema["a"].dataType
    lists = ranked.groupBy(*keys).agg(_in_rank_order(row_columns(ranked)).alias("trending_articles"))
    return totals.join(lists, keys, "left").select(
        generated_at.alias("generated_at"),
        *keys,
        F.lit(window_seconds).alias("window_seconds"),
        "total_events_in_window",
        "distinct_articles_in_window",
        F.coalesce("trending_articles", F.array().cast(row_type)).alias("trending_articles"),
    )


def ranked_rows(documents: DataFrame) -> DataFrame:
    """The ranked articles of stored documents as rows again."""
    entries = documents.select("window_start", "window_end", F.posexplode("trending_articles").alias("at", "row"))
    return entries.select("window_start", "window_end", "row.*", (F.col("at") + 1).alias("rank"))


def live_document(metrics: DataFrame, ranked: DataFrame, generated_at: Column) -> DataFrame:
    """Live metrics with the trending list nested."""
    return metrics.select(
        "*",
        ranked_list(ranked, row_columns(ranked)).scalar().alias("trending_articles"),
        generated_at.alias("generated_at"),
    )
