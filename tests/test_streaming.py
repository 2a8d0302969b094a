import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from editpulse.config import DEFAULTS
from editpulse.jobs import ingest, speed
from editpulse.operators import display, live, windows
from editpulse.plans import speed_layer
from editpulse.schemas import EVENT
from editpulse.sources import read_snapshot, read_snapshots, read_stream, with_arrival_time
from editpulse.streaming import (
    ProgressTable, ingest_stream, metrics_stream, sliding_count_stream, store_stream, trending_stream,
)
from editpulse.streaming.ingest import observed
from editpulse.operators.normalise import normalise
from helpers import edits, rows

SETTINGS = replace(DEFAULTS, window_seconds=300, slide_seconds=60, watermark_delay="60 seconds")
WINDOW = ("window_start", "window_end", "title", "recent_edits")


def add(spark, folder, points, name):
    """One more input file. Files are read in the order of their times."""
    path = str(folder / "staging" / name)
    edits(spark, points).coalesce(1).write.parquet(path)
    import pathlib
    import shutil

    (folder / "in").mkdir(exist_ok=True)
    part = next(pathlib.Path(path).glob("part-*.parquet"))
    shutil.copy(part, folder / "in" / f"{name}.parquet")
    return str(folder / "in")


def run_counts(spark, folder, per_trigger=1):
    stream = read_stream(spark, str(folder / "in"), EVENT, per_trigger=per_trigger)
    query = (
        sliding_count_stream(stream, SETTINGS).writeStream.outputMode("append").format("parquet")
        .option("path", str(folder / "out")).option("checkpointLocation", str(folder / "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


POINTS = [(i * 11 % 1500, f"t{i % 5}") for i in range(300)]
FIRST = sorted(p for p in POINTS if p[0] < 700)
SECOND = sorted(p for p in POINTS if p[0] >= 700)
END = [(9000, "end")]


def test_stream_equals_batch_over_files_and_a_restart(spark, tmp_path):
    add(spark, tmp_path, FIRST, "a")
    run_counts(spark, tmp_path)
    add(spark, tmp_path, [], "b-empty")
    add(spark, tmp_path, SECOND, "c")
    run_counts(spark, tmp_path)
    add(spark, tmp_path, END, "d")
    run_counts(spark, tmp_path)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = windows.sliding_counts(edits(spark, POINTS), 300, 60)
    assert rows(streamed, *WINDOW) == rows(batch, *WINDOW)


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    add(spark, tmp_path, [(0, "a"), (1000, "a")], "a")
    run_counts(spark, tmp_path)
    add(spark, tmp_path, [(1100, "a")], "b")
    run_counts(spark, tmp_path)
    add(spark, tmp_path, [(5, "late"), (1050, "in time")], "c")
    query = run_counts(spark, tmp_path)
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert dropped == 1
    add(spark, tmp_path, END, "d")
    run_counts(spark, tmp_path)
    found = {r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {"a", "in time"}


def test_trending_snapshots(spark, tmp_path):
    source = add(spark, tmp_path, FIRST + SECOND + END, "a")
    known = spark.createDataFrame([("t1", 100.0), ("t2", 3.0)], "title string, baseline_edits_per_hour double")
    out = str(tmp_path / "snapshots")

    def run():
        stream = read_stream(spark, source, EVENT)
        trending_stream(stream, lambda: known, out, str(tmp_path / "cp"), SETTINGS, seconds=None).awaitTermination()

    run()
    replay = speed_layer.trending_replay(edits(spark, POINTS), known, 300, 60)
    ranked = live.ranked_rows(read_snapshots(spark, out))
    columns = ("window_start", "title", "recent_edits", "trend_score", "rank")
    order = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert order(ranked) == order(replay)

    latest = read_snapshot(spark, out).first()
    last = max(r.window_end for r in replay.collect())
    counts = windows.sliding_counts(edits(spark, POINTS), 300, 60)
    newest = counts.where(F.col("window_end") == counts.agg(F.max("window_end")).first()[0]).collect()
    assert latest.total_events_in_window == sum(r.recent_edits for r in newest)
    assert latest.distinct_articles_in_window == len(newest)
    assert last <= max(r.window_end for r in counts.collect())

    names = {r.metric_name for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert names == {"SpeedLayerWindowEvents", "SpeedLayerTrendingArticleCount", "SpeedLayerProcessingLatencyMs"}

    documents = spark.read.json(f"{out}/history").count()
    run()
    assert spark.read.json(f"{out}/history").count() == documents
    assert order(live.ranked_rows(read_snapshots(spark, out))) == order(replay)


def test_no_window_finished_yet(spark, tmp_path):
    """An edit lies in an open window; nothing may be published that says there is none."""
    source = add(spark, tmp_path, [(0, "a")], "a")
    out = str(tmp_path / "quiet")
    trending_stream(read_stream(spark, source, EVENT), None, out, f"{out}-cp", SETTINGS, seconds=None).awaitTermination()
    assert read_snapshot(spark, out).collect() == []


def test_store_survives_a_restart(spark, tmp_path):
    source = add(spark, tmp_path, [(0, "a"), (86400, "b")], "a")
    target, checkpoint = str(tmp_path / "events"), str(tmp_path / "cp")

    def run():
        store_stream(read_stream(spark, source, EVENT), target, checkpoint, None).awaitTermination()

    run()
    add(spark, tmp_path, [(1, "c")], "b")
    run()
    run()
    stored = spark.read.parquet(target)
    assert rows(stored, "title") == [("a",), ("b",), ("c",)]
    assert stored.select("event_date").distinct().count() == 2
    newest = windows.trailing(stored, 300, anchor=edits(spark, [(86400, "x")]).first().timestamp)
    assert rows(newest, "title") == [("b",)]


def raw_lines(folder, name, records):
    (folder / "raw").mkdir(exist_ok=True)
    (folder / "raw" / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(folder / "raw")


RAW = [
    {"timestamp": 1709294400 + i, "title": f"t{i % 3}", "user": "u", "wiki": "enwiki", "bot": i % 4 == 0} for i in range(12)
] + ["broken", {"title": "no time"}]


def test_ingest_stream(spark, tmp_path):
    source = raw_lines(tmp_path, "a.txt", RAW)
    out = str(tmp_path / "out")

    def run():
        stream = read_stream(spark, source, source="text", per_trigger=1)
        ingest_stream(stream, out, str(tmp_path / "cp"), seconds=None).awaitTermination()

    run()
    raw_lines(tmp_path, "b.txt", RAW[:2])
    run()
    run()
    assert spark.read.parquet(f"{out}/events").count() == 10
    assert spark.read.parquet(f"{out}/bus").count() == 10
    assert rows(spark.read.parquet(f"{out}/rejects"), "reject_reason") == [("not_a_json_object",), ("timestamp",)]
    sums = spark.read.parquet(f"{out}/metrics").groupBy("metric_name").agg(F.sum("value").alias("v"))
    assert dict(map(tuple, sums.collect())) == {
        "total_received": 14.0, "total_accepted": 10.0, "total_filtered": 4.0, "total_parse_errors": 2.0,
    }


def test_observed_counters(spark, tmp_path):
    source = raw_lines(tmp_path, "a.txt", RAW)
    checked = observed(normalise(read_stream(spark, source, source="text")))
    query = checked.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    row = [p["observedMetrics"]["ingest"] for p in query.recentProgress if p["numInputRows"]][0]
    assert (row["total_received"], row["total_accepted"], row["total_parse_errors"]) == (12, 9, 2)


def test_every_report_and_late_row_is_stored(spark, tmp_path):
    listener = ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        add(spark, tmp_path, [(0, "a"), (1000, "a")], "a")
        run_counts(spark, tmp_path)
        add(spark, tmp_path, [(1100, "a")], "b")
        run_counts(spark, tmp_path)
        add(spark, tmp_path, [(5, "late"), (1050, "in time")], "c")
        run_counts(spark, tmp_path)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        sums = spark.read.parquet(str(tmp_path / "progress")).groupBy("metric_name").agg(F.sum("value").alias("v"))
        found = dict(map(tuple, sums.collect()))
    finally:
        spark.streams.removeListener(listener)
    assert (found["StreamInputRows"], found["StreamLateRows"]) == (5.0, 1.0)


def test_rate_metrics_stream(spark, tmp_path):
    source = add(spark, tmp_path, [(0, "a"), (1, "a"), (15, "a"), (500, "end")], "a")
    metrics_stream(read_stream(spark, source, EVENT), str(tmp_path / "m"), str(tmp_path / "cp"), SETTINGS, None).awaitTermination()
    found = rows(spark.read.parquet(str(tmp_path / "m")), "metric_name", "value")
    assert found == [
        ("IngestionEventsPerSecond", 0.1), ("IngestionEventsPerSecond", 0.2),
        ("IngestionEventsPublished", 1.0), ("IngestionEventsPublished", 2.0),
    ]


def test_arrival_time(spark):
    stamped = with_arrival_time(spark.createDataFrame([("A",)], "title string"))
    assert stamped.first().timestamp is not None


def test_jobs_end_to_end(spark, tmp_path):
    source = raw_lines(tmp_path, "a.txt", RAW)
    ingest.main(["--input", source, "--output", str(tmp_path / "i"), "--until-done", "--keep-bots"])
    events = spark.read.parquet(str(tmp_path / "i/events"))
    assert events.count() == 12

    end = events.limit(1).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    lines = display.bus_rows(events.unionByName(end)).select("value")
    lines.coalesce(1).write.text(str(tmp_path / "lines"))
    speed.main([
        "--input", str(tmp_path / "lines"), "--output", str(tmp_path / "s"), "--baseline", str(tmp_path / "none"),
        "--window-seconds", "300", "--slide-seconds", "60", "--until-done",
    ])
    ranked = live.ranked_rows(read_snapshots(spark, str(tmp_path / "s"))).where("window_start = timestamp'2024-03-01 12:00:00'")
    assert rows(ranked, "title", "recent_edits", "current_edits_per_hour") == [("t0", 4, 48.0), ("t1", 4, 48.0), ("t2", 4, 48.0)]


def test_submit_knows_its_jobs():
    import submit

    with pytest.raises(SystemExit):
        submit.main(["nothing"])
