"""

All queries run over the whole ``events`` table, seen as page edits (see
``editpulse.sources.event_log``). The table is sparse, so windows here are one
day wide. Timestamps are returned without zone, as the table stores them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import TimestampType

from editpulse.config import DEFAULTS
from editpulse.functions import hourly_rate, looks_anonymous, to_iso
from editpulse.operators import display, filters, history, live, normalise, rates, trend, windows
from editpulse.plans import serving, speed_layer
from editpulse.plans.batch_layer import run_batch_layer
from editpulse.plans.incremental import update_batch_layer
from editpulse.schemas import BATCH_TABLES
from editpulse.session import configure, run_folder
from editpulse.sinks import compact_store, read_store
from editpulse.sources import (
    StoredBaseline, read_baseline, read_event_json, read_landing, read_parts, read_snapshot, read_snapshots, read_stream, split_landing, split_large, store_baseline,
    union_parts,
)
from editpulse.sources.event_log import edits_from_log, raw_changes
from editpulse.sources.tables import create_event_table
from editpulse.streaming import (
    ingest_stream, land_stream, live_stream, metrics_stream, read_recent, read_ticks, recent_stream, store_stream, trending_stream,
)
from editpulse.streaming.trending import distinct_stream, sliding_count_stream

DAY = 86400
QUARTER_DAY = 21600
SMALLEST = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- inputs


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_from_log(configure(spark).read.parquet(f"{sf_dir}/events.parquet"))


def plain(df: DataFrame) -> DataFrame:
    """Zoned timestamps back to timestamps without zone."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def past_baseline(events: DataFrame) -> DataFrame:
    """The baseline from everything before the trailing day."""
    return history.baseline_with_sums(windows.before_trailing(events, DAY))


def staged(spark: SparkSession, frame: DataFrame, name: str, fmt: str = "parquet") -> str:
    """Write a frame to a new folder so a stream can read it."""
    path = f"{run_folder(spark, name)}/in"
    frame.write.format(fmt).save(path)
    return path


def zoned(events: DataFrame) -> DataFrame:
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


# ---------------------------------------------------------------- batch layer


def batch_layer_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = run_batch_layer(spark, edits(spark, sf_dir), run_folder(spark, "batch-out"))
        return plain(spark.read.parquet(paths[name]))

    return run


def baseline_for_titles(spark, sf_dir):
    events = edits(spark, sf_dir)
    return history.baseline_for(events, windows.trailing(events, DAY).select("title").distinct())


def baseline_for_list(spark, sf_dir):
    return history.baseline_for(edits(spark, sf_dir), [f"page_{i}" for i in range(0, 40)])


def event_time_columns(spark, sf_dir):
    events = edits(spark, sf_dir).select("event_id", to_iso(F.col("timestamp")).alias("text"))
    return plain(history.with_event_times(events, "text").drop("text"))


# ---------------------------------------------------------------- ingestion


def normalised(spark, sf_dir) -> DataFrame:
    return normalise.normalise(raw_changes(edits(spark, sf_dir)))


def normalised_events(spark, sf_dir):
    good = normalised(spark, sf_dir).where("reject_reason is null").select("event_id", "event.*")
    return plain(good)


def rejected_records(spark, sf_dir):
    return normalise.rejected(normalised(spark, sf_dir)).select("event_id", "reject_reason")


def ingest_filter(spark, sf_dir):
    return filters.ingest_filter(edits(spark, sf_dir)).select("event_id", "timestamp", "title", "user")


def anonymous_editors(spark, sf_dir):
    k = F.substring_index("title", "_", -1).cast("int")
    u = F.substring_index("user", "_", -1).cast("int")
    spelled = (
        F.when(u % 5 == 0, F.concat(F.lit("~2024-"), u.cast("string")))
        .when(u % 5 == 1, F.concat(F.lit("2001:db8::"), F.lower(F.hex(u)), F.lit(":"), k.cast("string"), F.lit("/64")))
        .when(u % 5 == 2, F.concat(F.lit("::ffff:10.0."), k.cast("string"), F.lit("."), (u * 3).cast("string")))
        .when(u % 5 == 3, F.concat(F.lit(" 10.0."), (u * 3).cast("string"), F.lit("."), k.cast("string")))
        .otherwise(F.col("user"))
    )
    named = edits(spark, sf_dir).select("event_id", spelled.alias("editor"))
    return named.select("event_id", "editor", looks_anonymous(F.col("editor")).alias("anonymous"))


def json_titles(spark, sf_dir):
    i = F.col("event_id")
    text = (
        F.when(i % 7 == 0, F.concat(F.lit('{"page_title":"'), "title", F.lit('"}')))
        .when(i % 7 == 1, F.concat(F.lit('{"title":"","page_title":"'), "title", F.lit('"}')))
        .when(i % 7 == 2, F.lit('{"title":null}'))
        .when(i % 7 == 3, F.lit("not json"))
        .otherwise(F.concat(F.lit('{"title":"'), "title", F.lit('","user":1}')))
    )
    records = edits(spark, sf_dir).select("event_id", F.encode(text, "UTF-8").alias("data"))
    return normalise.extract_titles(records, fallback_key="page_title").select("event_id", "title")


def json_title_counts(spark, sf_dir):
    raw = raw_changes(edits(spark, sf_dir)).select(F.encode("value", "UTF-8").alias("data"))
    return windows.title_counts(normalise.extract_titles(raw, replace_bad_bytes=False))


def keyed_bus_rows(spark, sf_dir):
    return display.bus_rows(edits(spark, sf_dir))


def landing_split(spark, sf_dir):
    """Objects that hold two values per edit without a separator between them."""
    pair = F.concat(
        F.to_json(F.struct("event_id", "title", F.lit("{a}{b}").alias("comment"))),
        F.to_json(F.struct("event_id", "user")),
    )
    path = staged(spark, edits(spark, sf_dir).select(pair.alias("value")), "landing", "text")
    values = split_landing(read_landing(spark, path)).where("error is null")
    fields = F.from_json("record", "event_id long, title string, comment string, user string")
    return values.select(fields.alias("r")).select("r.*")


def landing_split_large(spark, sf_dir):
    """All edits as a few objects without a line break, each read by several tasks."""
    value = F.to_json(F.struct("event_id", "title", F.lit('}{ " \\').alias("comment"), F.struct("user").alias("by")))
    edited = edits(spark, sf_dir).select(value.alias("value"))
    root = run_folder(spark, "landing-large")
    edited.coalesce(2).write.option("lineSep", " ").text(f"{root}/in")
    values = split_large(spark, f"{root}/in", f"{root}/work").where("error is null")
    fields = F.from_json("record", "event_id long, title string, comment string, by struct<user: string>")
    return values.select(fields.alias("r")).select("r.event_id", "r.title", "r.comment", "r.by.user")


# ---------------------------------------------------------------- speed layer


def trending_rate(spark, sf_dir):
    events = edits(spark, sf_dir)
    return speed_layer.trending_now(events, past_baseline(events), DAY)


def trending_rate_all(spark, sf_dir):
    events = edits(spark, sf_dir)
    return speed_layer.trending_now(events, past_baseline(events), DAY, trend.RATE_ALL)


def trending_no_baseline(spark, sf_dir):
    missing = read_baseline(spark, f"{run_folder(spark, 'absent')}/article_baseline")
    return speed_layer.trending_now(edits(spark, sf_dir), missing, DAY)


def trending_count(spark, sf_dir):
    return speed_layer.trending_now(edits(spark, sf_dir), None, DAY, trend.COUNT)


def trending_ratio(spark, sf_dir):
    return serving.trending_view(edits(spark, sf_dir), None, DAY)


def scored_articles(spark, sf_dir):
    events = edits(spark, sf_dir)
    counts = speed_layer.window_counts(events, DAY)
    return trend.score(counts, past_baseline(events), DAY, trend.RATE_ALL)


def live_metrics(spark, sf_dir):
    return live.live_metrics(windows.trailing(edits(spark, sf_dir), DAY), DAY)


def snapshot_totals(spark, sf_dir):
    return live.window_totals(speed_layer.window_counts(edits(spark, sf_dir), DAY))


def snapshot_nested(spark, sf_dir):
    events = edits(spark, sf_dir)
    stamp = F.lit("2024-01-31T00:00:00+00:00")
    document = speed_layer.snapshot_now(events, past_baseline(events), DAY, generated_at=stamp)
    as_text = F.to_json("trending_articles", {"ignoreNullFields": "false"})
    return document.withColumn("trending_articles", as_text)


def trailing_counts(spark, sf_dir):
    return plain(windows.trailing_counts(edits(spark, sf_dir), DAY))


def trailing_total(spark, sf_dir):
    return plain(windows.trailing_counts(edits(spark, sf_dir), 600, by=()))


def sliding_counts(spark, sf_dir):
    return plain(windows.sliding_counts(edits(spark, sf_dir), DAY, QUARTER_DAY))


def topn_per_window(spark, sf_dir):
    events = edits(spark, sf_dir)
    ranked = speed_layer.trending_replay(events, None, DAY, QUARTER_DAY, trend.COUNT)
    return plain(ranked)


def trending_replay(spark, sf_dir):
    events = edits(spark, sf_dir)
    ranked = speed_layer.trending_replay(events, history.baseline_with_sums(events), DAY, QUARTER_DAY)
    return plain(ranked)


def hourly_rates(spark, sf_dir):
    counts = history.article_counts(edits(spark, sf_dir))
    return counts.select("title", "edit_count", hourly_rate(F.col("edit_count"), DAY).alias("rate"))


# ---------------------------------------------------------------- rates and metrics


def ingest_rate_10s(spark, sf_dir):
    return plain(rates.ingest_rate(edits(spark, sf_dir)))


def ingest_rate_rollup(spark, sf_dir):
    return plain(rates.rate_rollup(rates.ingest_rate(edits(spark, sf_dir))))


def ingest_metric_samples(spark, sf_dir):
    return plain(rates.ingest_metrics(rates.ingest_rate(edits(spark, sf_dir))))


def snapshot_metric_samples(spark, sf_dir):
    events = edits(spark, sf_dir)
    document = speed_layer.snapshot_now(events, past_baseline(events), DAY, generated_at=F.lit(""))
    return plain(rates.snapshot_metrics(document, F.lit("2024-01-31 00:00:00").cast("timestamp")))


def run_speedup(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = log.groupBy((F.col("user_id") % 8 + 1).alias("executors")).agg(
        F.sum((F.col("value") * 100).cast("long")).cast("double").alias("runtime_seconds")
    )
    return rates.speedup(runs)


# ---------------------------------------------------------------- views


def display_trending(spark, sf_dir):
    return display.display_trending(trending_rate_all(spark, sf_dir).drop("rank"))


def trend_bars(spark, sf_dir):
    return display.bars(trending_ratio(spark, sf_dir), "trend_score").select("title", "trend_score")


def number_coercion(spark, sf_dir):
    texts = edits(spark, sf_dir).select("event_id", F.when(F.col("bot"), F.col("title")).otherwise(F.substring_index("title", "_", -1)).alias("text"))
    return texts.select("event_id", display.number(F.col("text")).alias("number"))


def display_baseline(spark, sf_dir):
    return display.display_baseline(history.article_baseline(edits(spark, sf_dir)))


def display_top_articles(spark, sf_dir):
    return display.display_top_articles(history.article_counts(edits(spark, sf_dir)))


def stored_views(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = run_folder(spark, "stored")
        run_batch_layer(spark, edits(spark, sf_dir), root)
        return serving.stored_views(spark, root)[name]

    return run


def history_view(spark, sf_dir):
    view = serving.history_view(edits(spark, sf_dir), 60, 24)
    nested = [f.name for f in view.schema.fields if f.dataType.typeName() in ("array", "struct")]
    for name in nested:
        if name == "edit_rate_history":
            view = view.withColumn(name, F.transform(name, lambda b: F.struct(to_iso(b["bucket"]).alias("bucket"), b["count"].alias("count"))))
        view = view.withColumn(name, F.to_json(name))
    return view


def live_view(spark, sf_dir):
    stamp = F.lit("2024-01-31T00:00:00+00:00")
    view = serving.live_view(edits(spark, sf_dir), None, DAY, generated_at=stamp)
    return view.withColumn("trending_articles", F.to_json("trending_articles"))


def health_view(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return serving.health_view(normalised(spark, sf_dir), DAY, now=now)


def recent_events(spark, sf_dir):
    events = edits(spark, sf_dir)
    return display.recent_events(events, 50, tie=["event_id"])


def event_stream_columns(spark, sf_dir):
    return plain(display.present_columns(edits(spark, sf_dir).drop("anonymous")))


def sql_view(spark, sf_dir):
    sql = """
        select title, count(*) as edits, count(distinct `user`) as editors
        from edits where namespace = ? and wiki = ? group by title
    """
    return serving.query(spark, sql, [0, "enwiki"], edits=edits(spark, sf_dir))


def union_of_parts(spark, sf_dir):
    events = edits(spark, sf_dir)
    parts = [events.where("bot").select("event_id", "title", "bot"), events.where("not bot").select("event_id", "title")]
    return union_parts(parts)


def stored_parts(spark, sf_dir):
    events = edits(spark, sf_dir).select("event_id", "title", "namespace")
    path = staged(spark, events, "parts")
    return read_parts(spark, path, events.schema)


def with_nulls(spark, sf_dir) -> DataFrame:
    events = edits(spark, sf_dir)
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("title")).alias("title"),
        F.when(F.col("event_id") % 5 != 0, F.col("user")).alias("user"),
    )


def stored_event_json(spark, sf_dir):
    """The bus payloads landed as JSON lines, read back as events."""
    path = staged(spark, display.bus_rows(edits(spark, sf_dir)).select("value"), "lines", "text")
    return plain(read_event_json(spark, path))


# ---------------------------------------------------------------- streams

STREAM_SETTINGS = replace(DEFAULTS, window_seconds=DAY, slide_seconds=QUARTER_DAY, watermark_delay="1 hour")


def closing(events: DataFrame) -> DataFrame:
    """The edits and one later record; its own windows stay open, all others are finished by it."""
    last = events.agg(
        (F.max("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("timestamp"), F.lit("end of stream").alias("title")
    )
    return events.unionByName(last, allowMissingColumns=True)


def edit_stream(spark: SparkSession, sf_dir: str, name: str, close: bool = True) -> tuple[DataFrame, str]:
    events = zoned(edits(spark, sf_dir))
    frame = closing(events) if close else events
    path = staged(spark, frame, name)
    return read_stream(spark, path, frame.schema), path.rsplit("/", 1)[0]


def stream_window_counts(spark, sf_dir):
    stream, root = edit_stream(spark, sf_dir, "window-counts")
    counts = sliding_count_stream(stream, STREAM_SETTINGS)
    query = (
        counts.writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return plain(spark.read.parquet(f"{root}/out"))


def run_trending_stream(spark, sf_dir) -> str:
    stream, root = edit_stream(spark, sf_dir, "trending")
    baseline = history.baseline_with_sums(edits(spark, sf_dir))
    query = trending_stream(stream, baseline, f"{root}/out", f"{root}/checkpoint", STREAM_SETTINGS, seconds=None)
    query.awaitTermination()
    return f"{root}/out"


def stream_trending(spark, sf_dir):
    out = run_trending_stream(spark, sf_dir)
    return plain(live.ranked_rows(read_snapshots(spark, out)))


def stream_snapshot(spark, sf_dir):
    latest = read_snapshot(spark, run_trending_stream(spark, sf_dir))
    return latest.select("window_seconds", "total_events_in_window", "distinct_articles_in_window")


def sliced_stream(spark: SparkSession, sf_dir: str, name: str, slices: int, close: bool) -> tuple[DataFrame, str]:
    """The edits in order of time, as so many files of equal duration, one a trigger."""
    events = zoned(edits(spark, sf_dir)).select("timestamp", "title")
    first, last = events.agg(F.unix_micros(F.min("timestamp")), F.unix_micros(F.max("timestamp"))).first()
    share = F.call_function("div", (F.unix_micros("timestamp") - first) * slices, F.lit(last - first))
    sliced = events.withColumn("slice", F.least(share, F.lit(slices - 1)))
    root = run_folder(spark, name)
    parts = [sliced.where(F.col("slice") == i).drop("slice") for i in range(slices)]
    for part in parts + ([closing(events).where("title = 'end of stream'")] if close else []):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    return read_stream(spark, f"{root}/in", events.schema, per_trigger=1), root


def stream_all_windows(spark, sf_dir):
    stream, root = sliced_stream(spark, sf_dir, "all-windows", 4, True)
    settings = replace(DEFAULTS, window_seconds=1800, slide_seconds=600, watermark_delay="10 minutes")
    live_stream(stream, f"{root}/out", f"{root}/checkpoint", None, settings, seconds=None).awaitTermination()
    documents = read_snapshots(spark, f"{root}/out")
    return plain(documents.select("window_start", "window_end", "total_events_in_window", "distinct_articles_in_window"))


def stream_current_window(spark, sf_dir):
    stream, root = sliced_stream(spark, sf_dir, "current-window", 5, False)
    live_stream(stream, f"{root}/out", f"{root}/checkpoint", None, STREAM_SETTINGS, trend.COUNT, seconds=None, keep=100).awaitTermination()
    documents = read_ticks(spark, f"{root}/out")
    totals = ["window_start", "window_end", "total_events_in_window", "distinct_articles_in_window"]
    rows = documents.select(*totals, F.posexplode_outer("trending_articles").alias("at", "row"))
    # A tick without data, when only the watermark moves, repeats the one before.
    return plain(rows.select(*totals, "row.title", "row.recent_edits", (F.col("at") + 1).alias("rank")).distinct())


def trending_partial_baseline(spark, sf_dir):
    """The ranking against a stored baseline that lacks a third of the titles and is probed for the candidates."""
    events = edits(spark, sf_dir)
    known = past_baseline(events).where(F.substring_index("title", "_", -1).cast("int") % 3 != 0)
    path = run_folder(spark, "stored-baseline")
    store_baseline(known, path, rows_per_bucket=16)
    counts = speed_layer.window_counts(events, DAY)
    candidates = counts.where(F.col("recent_edits") >= DEFAULTS.min_edits).select("title")
    return trend.trending(counts, StoredBaseline(spark, path)(candidates), DAY)


def event_table(spark: SparkSession, sf_dir: str) -> str:
    """Store the edits as a stream, in two runs; the name of the table over them."""
    events = zoned(edits(spark, sf_dir))
    root = run_folder(spark, "store")
    name = "edit_store_" + root.rsplit("-", 1)[-1]
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):
        events.where(half).write.mode("append").parquet(f"{root}/in")
        stream = read_stream(spark, f"{root}/in", events.schema)
        store_stream(stream, f"{root}/events", f"{root}/checkpoint", None).awaitTermination()
        create_event_table(spark, name, f"{root}/events")
    return name


def stream_store(spark, sf_dir):
    name = event_table(spark, sf_dir)
    stored = plain(spark.table(name).drop("event_date"))
    spark.sql(f"DROP TABLE {name}")  # the frame has resolved its files
    return stored


def stream_store_compacted(spark, sf_dir):
    """The store after closed dates were merged, more edits came into them, and they were merged again."""
    events = zoned(edits(spark, sf_dir))
    root = run_folder(spark, "compacted")
    last = str(events.agg(F.to_date(F.max("timestamp"))).first()[0])
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{root}/in")
        store_stream(read_stream(spark, f"{root}/in", events.schema), f"{root}/events", f"{root}/checkpoint", None).awaitTermination()
        if part < 2:
            compact_store(spark, f"{root}/events", last)
    return plain(read_store(spark, f"{root}/events").drop("event_date"))


def sql_event_table(spark, sf_dir):
    name = event_table(spark, sf_dir)
    sql = f"select event_date, title, count(*) as edits from {name} where namespace = ? group by event_date, title"
    found = serving.query(spark, sql, [0])
    found.schema
    spark.sql(f"DROP TABLE {name}")
    return found


def baseline_for_long_list(spark, sf_dir):
    return history.baseline_for(edits(spark, sf_dir), [f"page_{i}" for i in range(0, 4000, 2)])


def stream_ingest(spark, sf_dir):
    raw = raw_changes(edits(spark, sf_dir)).select("value")
    path = staged(spark, raw, "ingest", "text")
    root = path.rsplit("/", 1)[0]
    ingest_stream(read_stream(spark, path, source="text"), f"{root}/out", f"{root}/checkpoint", seconds=None).awaitTermination()
    return plain(spark.read.parquet(f"{root}/out/events").drop("batch_id", "event_date"))


def stream_ingest_bus(spark, sf_dir):
    """What the bus got: the place of each event among those of its key."""
    raw = raw_changes(edits(spark, sf_dir)).select("value")
    path = staged(spark, raw, "ingest-bus", "text")
    root = path.rsplit("/", 1)[0]
    ingest_stream(read_stream(spark, path, source="text"), f"{root}/out", f"{root}/checkpoint", seconds=None).awaitTermination()
    rows = spark.read.parquet(f"{root}/out/bus")
    place = F.row_number().over(Window.partitionBy("key").orderBy("batch_id", "sequence"))
    fields = F.from_json("value", "timestamp string, user string, wiki string")
    return rows.select("key", place.alias("place"), fields.alias("f")).select("key", "place", "f.*")


def stream_recent_events(spark, sf_dir):
    """The newest events after several files and a restart."""
    events = zoned(edits(spark, sf_dir))
    root = run_folder(spark, "recent")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{root}/in")
        stream = read_stream(spark, f"{root}/in", events.schema, per_trigger=4)
        recent_stream(stream, f"{root}/out", f"{root}/checkpoint", seconds=None, tie=["event_id"]).awaitTermination()
    return read_recent(spark, f"{root}/out", 50, tie=["event_id"])


def sliding_distincts(spark, sf_dir):
    """Editors and articles of each window: exact, and whether the estimates of the stream are within their bound."""
    events = edits(spark, sf_dir)
    stream, root = edit_stream(spark, sf_dir, "distincts")
    estimates = distinct_stream(stream, ["user", "title"], STREAM_SETTINGS)
    query = estimates.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
    query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    near = plain(spark.read.parquet(f"{root}/out"))
    exact = plain(windows.sliding_distincts(events, ["user", "title"], DAY, QUARTER_DAY))
    close = lambda c: F.abs(F.col(f"near_{c}") - F.col(f"distinct_{c}")) <= windows.DISTINCT_ERROR * F.col(f"distinct_{c}")
    joined = exact.join(near.select("window_start", "near_user", "near_title", F.col("edits").alias("near_edits")), "window_start", "left")
    within = close("user") & close("title") & (F.col("edits") == F.col("near_edits"))
    return joined.select("window_start", "window_end", "edits", "distinct_user", "distinct_title", F.coalesce(within, F.lit(False)).alias("within"))


@lru_cache(maxsize=4)
def incremental_tables(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The batch layer after two runs, each over the half of the edits that is new to it."""
    events = zoned(edits(spark, sf_dir))
    root = run_folder(spark, "incremental")
    for half in ("event_id % 2 = 0", "event_id % 2 = 1"):
        events.where(half).write.mode("append").parquet(f"{root}/in")
        paths = update_batch_layer(spark, f"{root}/in", f"{root}/out")
    return paths


def incremental_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(spark.read.parquet(incremental_tables(configure(spark), sf_dir)[name]))


def stream_landing(spark, sf_dir):
    records = zoned(edits(spark, sf_dir)).select(F.col("timestamp").alias("arrived_at"), F.col("title").alias("value"))
    path = staged(spark, records, "land")
    root = path.rsplit("/", 1)[0]
    land_stream(read_stream(spark, path, records.schema), f"{root}/out", f"{root}/checkpoint", None).awaitTermination()
    stored = spark.read.option("basePath", f"{root}/out").text(f"{root}/out")
    return stored.groupBy(F.col("event_date").cast("string").alias("event_date"), F.col("event_hour").cast("int").alias("event_hour"), "value").count()


def stream_ingest_metrics(spark, sf_dir):
    stream, root = edit_stream(spark, sf_dir, "rate", close=True)
    # The closing record opens an interval of its own, which never ends.
    metrics_stream(stream, f"{root}/out", f"{root}/checkpoint", seconds=None).awaitTermination()
    return plain(spark.read.parquet(f"{root}/out"))


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Articles edited faster than usual in the last day of the smallest data set."""
    return trending_rate(spark, SMALLEST)


def on_edits(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(operator(edits(spark, sf_dir)))


def corpus_registry():
    """The queries of the ``llm`` subpackage, or None where that is not installed."""
    try:
        from editpulse.llm import registry
    except ModuleNotFoundError as error:
        if (error.name or "").split(".")[0] in ("editpulse", "corpus_pipeline"):
            return None
        raise
    return registry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    corpus = corpus_registry()
    return edit_queries() | (corpus.QUERIES if corpus else {})


def edit_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "events_total_and_distinct": on_edits(history.totals),
        "top_articles": on_edits(history.top_articles),
        "article_counts": on_edits(history.article_counts),
        "bot_rows": on_edits(history.bot_counts),
        "bot_vs_human": on_edits(history.bot_vs_human),
        "namespace_breakdown": on_edits(history.namespace_ranking),
        "edit_rate_hourly": on_edits(history.hourly_counts),
        "article_hourly": on_edits(history.article_hours),
        "article_baseline": on_edits(history.article_baseline),
        "hour_rollup": on_edits(history.hour_rollup),
        "baseline_for_titles": baseline_for_titles,
        "baseline_for_list": baseline_for_list,
        "baseline_for_long_list": baseline_for_long_list,
        "edit_rate_buckets_5m": on_edits(lambda e: history.edit_rate_buckets(e, 5, 48)),
        "edit_rate_buckets_7m": on_edits(lambda e: history.edit_rate_buckets(e, 7, 500)),
        "event_time_columns": event_time_columns,
        "batch_layer_top_articles": batch_layer_table("top_articles"),
        "batch_layer_baseline": batch_layer_table("article_baseline"),
        "batch_layer_summary": batch_layer_table("summary"),
        "batch_layer_hourly": batch_layer_table("edit_rate_hourly"),
        "batch_layer_bots": batch_layer_table("bot_vs_human"),
        "batch_layer_namespaces": batch_layer_table("namespace_breakdown"),
        **{f"incremental_{name}": incremental_table(name) for name in BATCH_TABLES},
        "normalised_events": normalised_events,
        "rejected_records": rejected_records,
        "ingest_counters": lambda s, d: normalise.ingest_counters(normalised(s, d)),
        "ingest_filter": ingest_filter,
        "looks_anonymous": anonymous_editors,
        "json_title_extract": json_titles,
        "json_title_counts": json_title_counts,
        "keyed_bus_rows": keyed_bus_rows,
        "landing_split": landing_split,
        "landing_split_large": landing_split_large,
        "stored_event_json": stored_event_json,
        "trending_rate": trending_rate,
        "trending_rate_all": trending_rate_all,
        "trending_no_baseline": trending_no_baseline,
        "trending_partial_baseline": trending_partial_baseline,
        "trending_count": trending_count,
        "trending_ratio": trending_ratio,
        "scored_articles": scored_articles,
        "hourly_rates": hourly_rates,
        "live_metrics": live_metrics,
        "snapshot_totals": snapshot_totals,
        "snapshot_nested": snapshot_nested,
        "trailing_counts": trailing_counts,
        "trailing_total": trailing_total,
        "sliding_counts": sliding_counts,
        "topn_per_window": topn_per_window,
        "trending_replay": trending_replay,
        "ingest_rate_10s": ingest_rate_10s,
        "ingest_rate_5m_rollup": ingest_rate_rollup,
        "ingest_metric_samples": ingest_metric_samples,
        "snapshot_metric_samples": snapshot_metric_samples,
        "run_speedup": run_speedup,
        "trend_bars": trend_bars,
        "number_coercion": number_coercion,
        "event_rows": on_edits(display.event_row),
        "display_trending": display_trending,
        "display_baseline": display_baseline,
        "display_top_articles": display_top_articles,
        "stored_summary": stored_views("summary"),
        "stored_top_articles": stored_views("top_articles"),
        "stored_baseline": stored_views("article_baseline"),
        "history_view": history_view,
        "live_view": live_view,
        "health_view": health_view,
        "recent_events": recent_events,
        "event_stream_columns": event_stream_columns,
        "sql_view_param": sql_view,
        "union_parts": union_of_parts,
        "stored_parts": stored_parts,
        "dropna_any": lambda s, d: filters.drop_if_any_null(with_nulls(s, d), ["title", "user"]),
        "dropna_all": lambda s, d: filters.drop_if_all_null(with_nulls(s, d), ["title", "user"]),
        "with_title": lambda s, d: filters.with_title(with_nulls(s, d)),
        "trailing_events": lambda s, d: plain(windows.trailing(edits(s, d), DAY).select("event_id", "timestamp", "title")),
        "distinct_editors": on_edits(history.editors),
        "stream_window_counts": stream_window_counts,
        "stream_trending": stream_trending,
        "stream_snapshot": stream_snapshot,
        "stream_all_windows": stream_all_windows,
        "stream_current_window": stream_current_window,
        "stream_store": stream_store,
        "stream_store_compacted": stream_store_compacted,
        "sql_event_table": sql_event_table,
        "stream_ingest": stream_ingest,
        "stream_ingest_bus": stream_ingest_bus,
        "stream_recent_events": stream_recent_events,
        "sliding_distincts": sliding_distincts,
        "stream_landing": stream_landing,
        "stream_ingest_metrics": stream_ingest_metrics,
    }


def oracle_sql() -> dict[str, str]:
    from oracle_queries import ORACLE

    corpus = corpus_registry()
    return ORACLE | (corpus.SQL if corpus else {})
