"""Fixed schemas. Nothing in the engine infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

# A normalised edit event: what the store holds and every operator reads.
EVENT = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("user", T.StringType()),
    T.StructField("anonymous", T.BooleanType()),
    T.StructField("bot", T.BooleanType()),
    T.StructField("comment", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("namespace", T.IntegerType()),
    T.StructField("wiki", T.StringType()),
    T.StructField("server_name", T.StringType()),
])

# The same event as JSON on the bus: the timestamp is ISO-8601 text.
WIRE_EVENT = T.StructType(
    [T.StructField("timestamp", T.StringType())]
    + [T.StructField(f.name, f.dataType) for f in EVENT.fields[1:]]
)

BASELINE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("baseline_edits_per_hour", T.DoubleType()),
])

TRENDING_ROW = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("recent_edits", T.LongType()),
    T.StructField("current_edits_per_hour", T.DoubleType()),
    T.StructField("baseline_edits_per_hour", T.DoubleType()),
    T.StructField("trend_score", T.DoubleType()),
    T.StructField("baseline_available", T.BooleanType()),
])

SNAPSHOT = T.StructType([
    T.StructField("generated_at", T.StringType()),
    T.StructField("window_seconds", T.IntegerType()),
    T.StructField("total_events_in_window", T.LongType()),
    T.StructField("distinct_articles_in_window", T.LongType()),
    T.StructField("trending_articles", T.ArrayType(TRENDING_ROW)),
])

# As stored by the stream: with the window the document describes.
WINDOW_SNAPSHOT = T.StructType([
    SNAPSHOT["generated_at"],
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    *SNAPSHOT.fields[1:],
])

METRIC = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# The names of the tables the batch layer writes.
BATCH_TABLES = (
    "top_articles",
    "bot_vs_human",
    "namespace_breakdown",
    "edit_rate_hourly",
    "article_baseline",
    "summary",
)
