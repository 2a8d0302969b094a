"""The current window at every tick, every finished window, and the baseline that is probed."""

import time
from collections import Counter
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from editpulse.config import DEFAULTS
from editpulse.operators import live, trend
from editpulse.schemas import EVENT
from editpulse.sinks import CommitLog
from editpulse.sources import StoredBaseline, read_snapshots, read_stream, store_baseline, with_arrival_time
from editpulse.streaming import LiveWindows, live_stream, read_current, read_ticks, with_clock
from helpers import START, at
from test_streaming import add

SLIDE, WINDOW, DELAY = 10, 60, 20
SETTINGS = replace(DEFAULTS, window_seconds=WINDOW, slide_seconds=SLIDE, watermark_delay=f"{DELAY} seconds", min_edits=2)
BASE = int(START.timestamp())

FILES = [
    [(0, "a"), (3, "a"), (12, "b"), (25, "a"), (7, "")],
    [(31, "a"), (18, "b"), (33, "c"), (48, "c"), (49, None)],
    [(52, "c"), (66, "c"), (71, "a")],
    [(75, "b"), (300, "a")],  # a long quiet spell ends
    [(301, "a")],
    [(305, "late"), (250, "late"), (282, "b"), (310, "a")],
    [(400, "z")],
]


def model(files, windows):
    """Per tick the current window, and all finished windows, from the rows that came in time."""
    kept, ticks, finished, newest, published = [], [], {}, None, None
    for file, window in zip(files, windows):
        passed = None if newest is None else newest - DELAY
        kept += [(s, t) for s, t in file if passed is None or s // SLIDE * SLIDE + SLIDE > passed]
        newest = max([s for s, _ in file] + ([newest] if newest is not None else []))
        titled = [(s, t) for s, t in kept if t]
        end = (newest // SLIDE + 1) * SLIDE
        count = lambda end, window: Counter(t for s, t in titled if end - window <= s // SLIDE * SLIDE < end)
        ticks.append((end - window, end, count(end, window)))
        last = (newest - DELAY) // SLIDE * SLIDE
        first = min(s for s, _ in titled) // SLIDE * SLIDE + SLIDE if published is None else published + SLIDE
        for e in range(first, last + 1, SLIDE):
            finished[e] = (e - window, count(e, window))
            published = e
    return ticks, finished


def totals(documents):
    return [
        (r.s, r.e, r.total_events_in_window, r.distinct_articles_in_window, sorted((x.title, x.recent_edits) for x in r.trending_articles))
        for r in documents.withColumns({"s": F.unix_seconds("window_start") - BASE, "e": F.unix_seconds("window_end") - BASE}).orderBy("e").collect()
    ]


def as_row(start, end, counts):
    return start, end, sum(counts.values()), len(counts), sorted((t, n) for t, n in counts.items() if n >= 2)


def start_stream(spark, folder, **options):
    stream = read_stream(spark, str(folder / "in"), EVENT, per_trigger=1)
    query = live_stream(stream, str(folder / "out"), str(folder / "cp"), None, options.pop("settings", SETTINGS), seconds=None, keep=100, **options)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("restart", [False, True])
def test_every_window_over_files_and_restarts(spark, tmp_path, restart):
    for i, points in enumerate(FILES):
        add(spark, tmp_path, sorted(points, key=str), f"{i}")
        time.sleep(0.01)
        if restart:
            start_stream(spark, tmp_path)
    query = start_stream(spark, tmp_path)
    ticks, finished = model(FILES, [WINDOW] * len(FILES))
    found = read_ticks(spark, str(tmp_path / "out"))
    # Spark adds ticks without data, when only the watermark moves; they repeat the window.
    assert sorted({str(t) for t in totals(found)}) == sorted({str(as_row(*t)) for t in ticks})
    history = totals(read_snapshots(spark, str(tmp_path / "out")))
    assert history == [as_row(start, end, counts) for end, (start, counts) in sorted(finished.items())]
    assert any(n == 0 for _, _, n, _, _ in history) and history[-1][1] <= 400 - DELAY
    assert totals(read_current(spark, str(tmp_path / "out"))) == [as_row(*ticks[-1])]
    if not restart:
        rows = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
        open_panes = DELAY // SLIDE + 2
        assert max(rows) <= open_panes * 5


def test_window_length_changes_while_it_runs(spark, tmp_path):
    sizes = [60, 60, 30, 30, 120, 120, 120]
    for i, points in enumerate(FILES):
        add(spark, tmp_path, sorted(points, key=str), f"{i}")
        start_stream(spark, tmp_path, window=lambda: sizes[i], longest=120)
    ticks, finished = model(FILES, sizes)
    assert {str(t) for t in totals(read_ticks(spark, str(tmp_path / "out")))} == {str(as_row(*t)) for t in ticks}
    history = totals(read_snapshots(spark, str(tmp_path / "out")))
    assert history == [as_row(start, end, counts) for end, (start, counts) in sorted(finished.items())]


def test_a_window_must_fit(spark, tmp_path):
    for wrong in (25, 0, 90):
        with pytest.raises(ValueError):
            LiveWindows(str(tmp_path), settings=SETTINGS, window=lambda: wrong)._window()


def batch(spark, rows):
    return spark.createDataFrame(
        [(BASE + p, t, n, at(s)) for p, t, n, s in rows], "pane long, title string, edits long, newest timestamp"
    )


def test_a_repeated_tick_changes_nothing_and_panes_are_merged(spark, tmp_path):
    out = str(tmp_path / "out")
    windows = LiveWindows(out, None, SETTINGS, trend.RATE, keep=1, merge_after=3)
    for i in range(12):
        rows = batch(spark, [(10 * i, "a", 1, 10 * i), (10 * i, "b", 2 + i, 10 * i + 9)] + ([(10 * i - 10, "a", 3, 10 * i - 1)] if i else []))
        for _ in range(2):
            windows.tick(rows, i)
    windows.tick(batch(spark, []), 12)
    newest = totals(read_current(spark, out))
    # Six panes of a (three edits each but for the newest) and b.
    assert newest == [(60, 120, 16 + sum(2 + i for i in range(6, 12)), 2, [("a", 16), ("b", sum(2 + i for i in range(6, 12)))])]
    assert [t[1] for t in totals(read_snapshots(spark, out))] == list(range(10, 100, 10))
    left = lambda name: len(list((tmp_path / "out" / name).glob("batch_id=*")))
    assert left("panes") <= 6 and left("totals") <= 3 and left("merged") <= 2 and left("current") <= 3
    assert len(CommitLog(spark, f"{out}/commits").numbers()) <= 3


def test_nothing_yet(spark, tmp_path):
    out = str(tmp_path / "out")
    assert read_current(spark, out).count() == 0
    LiveWindows(out, settings=SETTINGS).tick(batch(spark, []), 0)
    assert read_current(spark, out).count() == 0


def test_time_goes_on_without_edits(spark, tmp_path):
    """Arrival time and no delay: a window is finished as soon as it ends, whether edits come or not."""
    source = add(spark, tmp_path, [(0, "a"), (0, "a"), (0, "b")], "a")
    settings = replace(SETTINGS, window_seconds=2, slide_seconds=1, watermark_delay="0 seconds")
    stream = with_clock(with_arrival_time(read_stream(spark, source, EVENT)))
    query = live_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), None, settings, seconds=1)
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            time.sleep(1)
            log = CommitLog(spark, f"{tmp_path}/out/commits").latest()
            if log and (log[1]["published"] or 0) >= log[1].get("oldest", 2**40) + 6:
                break
    finally:
        query.stop()
    history = totals(read_snapshots(spark, str(tmp_path / "out")))
    assert [t[2] for t in history[:4]] == [3, 3, 0, 0]
    assert [t[1] for t in history] == list(range(history[0][1], history[0][1] + len(history)))


def test_commits_are_whole_and_ordered(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() is None
    for n in (0, 2, 10):
        log.put(n, {"n": n})
    log.put(2, {"n": "again"})
    assert log.latest() == (10, {"n": 10}) and log.latest(below=10) == (2, {"n": "again"})
    log.forget(10)
    assert log.numbers() == [10]


def files_read(collected):
    scan = collected._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numFiles").value()


def test_baseline_probe_reads_the_buckets_asked_for(spark, tmp_path):
    path = str(tmp_path / "baseline")
    probe = StoredBaseline(spark, path)
    asked = spark.createDataFrame([("t7",), ("t7",), ("unknown",), (None,)], "title string")
    assert probe(asked).count() == 0
    known = spark.range(2000).select(F.concat(F.lit("t"), "id").alias("title"), (F.col("id") + 0.5).alias("baseline_edits_per_hour"))
    store_baseline(known, path, rows_per_bucket=20)
    rows = probe(asked)
    assert [tuple(r) for r in rows.collect()] == [("t7", 7.5)]
    assert 0 < files_read(rows) <= 3
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "In(title, [" in plan
    many = spark.range(500).select(F.concat(F.lit("t"), "id").alias("title"))
    assert probe(many).join(many, "title").count() == 500
    some = probe(many.limit(30))
    some.collect()
    assert files_read(some) <= 30 < len(list(Path(path).glob("version=0/*/*.parquet")))
    for _ in range(3):
        store_baseline(known.limit(10), path)
    assert probe(many).count() == 10 and len(list(Path(path).glob("version=*"))) == 2


def test_stream_with_a_stored_baseline(spark, tmp_path):
    path = str(tmp_path / "baseline")
    store_baseline(spark.createDataFrame([("a", 30.0), ("x", 1.0)], "title string, baseline_edits_per_hour double"), path)
    add(spark, tmp_path, FILES[0], "0")
    stream = read_stream(spark, str(tmp_path / "in"), EVENT)
    live_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), StoredBaseline(spark, path), SETTINGS, seconds=None).awaitTermination()
    ranked = live.ranked_rows(read_current(spark, str(tmp_path / "out"))).collect()
    assert [(r.title, r.recent_edits, r.trend_score, r.baseline_available) for r in ranked] == [("a", 3, 6.0, True)]
