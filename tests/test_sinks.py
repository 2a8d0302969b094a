"""Keyed rows, the buffer of recent events, distinct counts by sketch, and the layout of the ingest job."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from editpulse.config import DEFAULTS
from editpulse.jobs import ingest
from editpulse.operators import windows
from editpulse.schemas import EVENT
from editpulse.sinks import CommitLog, write_keyed
from editpulse.sources import read_stream
from editpulse.streaming import ingest_stream, read_recent, recent_stream
from editpulse.streaming.trending import distinct_stream
from helpers import at, edits, rows
from test_streaming import END, RAW, add, raw_lines

SETTINGS = replace(DEFAULTS, window_seconds=300, slide_seconds=60, watermark_delay="60 seconds")


def test_rows_of_a_key_are_in_order_and_a_hot_key_is_split(spark, tmp_path):
    """Two thirds of the rows have one key; no task holds all of them, and the sequence still follows the time."""
    made = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.col("id").cast("string").alias("value"), F.pmod(F.hash("id"), F.lit(10**6)).alias("at"),
    )
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in (0, 1, 1):
            write_keyed(made.where(F.col("id") % 2 == batch), str(tmp_path), batch, ["at", "value"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    found = spark.read.parquet(str(tmp_path))
    assert found.count() == 6000
    by_key = {}
    for r in found.orderBy("batch_id", "sequence").collect():
        by_key.setdefault((r.batch_id, r.key), []).append((r["at"], r.value))
    assert all(v == sorted(v) for v in by_key.values())
    files = found.where("key = 'hot' and batch_id = 0").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 2 and max(f["count"] for f in files) < 2000


def test_recent_events_over_files_and_a_restart(spark, tmp_path):
    out = str(tmp_path / "out")
    assert read_recent(spark, out, 3).collect() == []
    points = [(i * 37 % 500, f"t{i:03}") for i in range(120)]

    def run():
        stream = read_stream(spark, str(tmp_path / "in"), EVENT, per_trigger=1)
        recent_stream(stream, out, str(tmp_path / "cp"), keep=30, seconds=None).awaitTermination()

    for i in range(3):
        add(spark, tmp_path, points[i * 40 : i * 40 + 20], f"{i}a")
        add(spark, tmp_path, points[i * 40 + 20 : i * 40 + 40], f"{i}b")
        run()
    expected = [t for s, t in sorted(points, reverse=True)[:30]]
    assert [r.title for r in read_recent(spark, out, 30).collect()] == expected
    assert [r.title for r in read_recent(spark, out, 5).collect()] == expected[:5]
    last = CommitLog(spark, f"{out}/commits").latest()[1]["buffer"]
    assert spark.read.parquet(f"{out}/{last}").count() == 30
    assert len(list((tmp_path / "out/buffer").glob("batch_id=*"))) <= 2


def test_distinct_counts_by_sketch(spark, tmp_path):
    points = [(i % 900, f"t{i * 7919 % 400}", f"u{i * 104729 % 3000}", False) for i in range(6000)]
    source = add(spark, tmp_path, sorted(points) + [(*END[0], "x", False)], "a")
    estimates = distinct_stream(read_stream(spark, source, EVENT), ["user", "title"], SETTINGS)
    query = estimates.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    near = {r.window_start: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    exact = windows.sliding_distincts(edits(spark, points), ["user", "title"], 300, 60).collect()
    assert len(exact) == len(near) > 15
    for r in exact:
        inside = {(u, t) for s, t, u, _ in points if r.window_start <= at(s).replace(tzinfo=None) < r.window_end}
        assert (r.distinct_user, r.distinct_title) == (len({u for u, _ in inside}), len({t for _, t in inside}))
        other = near[r.window_start]
        assert other.edits == r.edits
        assert abs(other.near_user - r.distinct_user) <= windows.DISTINCT_ERROR * r.distinct_user
        assert abs(other.near_title - r.distinct_title) <= windows.DISTINCT_ERROR * r.distinct_title


def test_ingested_events_lie_by_date(spark, tmp_path):
    later = [dict(r, timestamp=r["timestamp"] + 2 * 86400) for r in RAW[:6]]
    source = raw_lines(tmp_path, "a.txt", RAW + later)
    out = str(tmp_path / "out")
    ingest_stream(read_stream(spark, source, source="text"), out, str(tmp_path / "cp"), seconds=None).awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    assert {str(r.event_date) for r in events.select("event_date").distinct().collect()} == {"2024-03-01", "2024-03-03"}
    newest = windows.trailing(events, 300)
    assert newest.count() == 4
    assert "PartitionFilters: [isnotnull(event_date" in newest._jdf.queryExecution().toString()
    assert list((tmp_path / "out/normalised").glob("batch_id=*")) == []


def test_ingest_job_starts_its_streams(spark, tmp_path):
    source = raw_lines(tmp_path, "a.txt", RAW + [dict(RAW[0], timestamp=RAW[0]["timestamp"] + 900)])
    out = tmp_path / "i"
    ingest.main(["--input", source, "--output", str(out), "--until-done", "--keep-bots", "--rates", "--land", "--recent"])
    assert spark.read.parquet(f"{out}/events").count() == 13
    published = spark.read.parquet(f"{out}/rates").where("metric_name = 'IngestionEventsPublished'")
    assert rows(published, "value") == [(1.0,), (2.0,), (10.0,)]
    assert spark.read.text(f"{out}/landed").count() == len(RAW) + 1
    assert [r.title for r in read_recent(spark, f"{out}/recent", 2).collect()] == ["t0", "t2"]


def test_a_buffer_takes_only_what_it_may(spark, tmp_path):
    with pytest.raises(ValueError):
        read_recent(spark, str(tmp_path), 0)


def test_keyed_rows_of_nothing(spark, tmp_path):
    write_keyed(spark.createDataFrame([], "key string, value string, at int"), str(tmp_path), 0, ["at"])
    assert rows(spark.read.parquet(str(tmp_path)), "key") == []
