"""Small event frames for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

START = datetime(2024, 3, 1, 12, 0, 0, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def edits(spark, rows):
    """rows: (seconds after START, title[, user[, bot]])."""
    full = []
    for row in rows:
        second, title, user, bot = (*row, *("ann", False)[len(row) - 2:]) if len(row) < 4 else row
        full.append((None if second is None else at(second), title, user, False, bot, "", "edit", 0, "enwiki", ""))
    return spark.createDataFrame(
        full,
        "timestamp timestamp, title string, user string, anonymous boolean, bot boolean, comment string, "
        "event_type string, namespace int, wiki string, server_name string",
    )


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
