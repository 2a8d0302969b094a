import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from editpulse.operators import windows
from helpers import START, at, edits, rows


def micros(t):
    return round((t.timestamp() - START.timestamp()) * 1_000_000) if t else None


def brute_trailing(points, seconds):
    """points: (microsecond, key)"""
    out = {}
    for t, key in points:
        out[(key, t)] = sum(1 for u, k in points if k == key and t - seconds * 1_000_000 <= u <= t)
    return out


@pytest.mark.parametrize("seconds", [300, 7, 86400])
def test_trailing_counts_against_brute_force(spark, seconds):
    rng = random.Random(seconds)
    span = seconds * 8
    points = []
    for _ in range(400):
        # a third of the events belong to one key, many of them at the same instants
        key = "hot" if rng.random() < 0.35 else rng.choice("abc")
        step = rng.choice([1, seconds * 1_000_000 // 60, 1_000_000])
        points.append((rng.randrange(0, span * 1_000_000 // step) * step, key))
    points += [(0, "edge"), (seconds * 1_000_000, "edge"), (seconds * 1_000_000 + 1, "edge"), (3, None), (4, None)]
    frame = spark.createDataFrame(points, "m long, title string").select(
        F.timestamp_micros(F.col("m") + int(START.timestamp()) * 1_000_000).alias("timestamp"), "title"
    )
    found = windows.trailing_counts(frame, seconds).withColumn(
        "m", F.unix_micros("timestamp") - int(START.timestamp()) * 1_000_000
    ).collect()
    assert {(r.title, r.m): r.trailing_edits for r in found} == brute_trailing(points, seconds)
    assert {(r.title, r.m): r.edits for r in found} == Counter((k, t) for t, k in points)

    total = windows.trailing_counts(frame, seconds, by=()).withColumn(
        "m", F.unix_micros("timestamp") - int(START.timestamp()) * 1_000_000
    ).collect()
    everything = brute_trailing([(t, "") for t, _ in points], seconds)
    assert {("", r.m): r.trailing_edits for r in total} == everything


def test_trailing_bounds_are_inclusive(spark):
    events = edits(spark, [(0, "old"), (1, "edge"), (2, "in"), (301, "now"), (400, "future")])
    kept = windows.trailing(events, 300, anchor=at(301))
    assert rows(kept, "title") == [("edge",), ("in",), ("now",)]
    assert rows(windows.before_trailing(events, 300, anchor=at(301)), "title") == [("old",)]
    assert rows(windows.trailing(events, 300), "title") == [("future",), ("now",)]


def test_sliding_counts_against_brute_force(spark):
    rng = random.Random(3)
    points = [(rng.randrange(0, 1200), rng.choice("ab")) for _ in range(200)]
    found = windows.sliding_counts(edits(spark, points), 300, 10).collect()
    expected = Counter()
    for second, title in points:
        first = second // 10 * 10
        for start in range(first - 290, first + 10, 10):
            expected[(start, title)] += 1
    assert {(micros(r.window_start) // 1_000_000, r.title): r.recent_edits for r in found} == expected
    assert all((r.window_end - r.window_start).total_seconds() == 300 for r in found)


@pytest.mark.parametrize("at_least", [2, 3, 6])
def test_busy_windows_only(spark, at_least):
    rng = random.Random(at_least)
    points = [(rng.randrange(0, 6000), f"t{rng.randrange(25)}") for _ in range(250)]
    points += [(299, "edge"), (300, "edge"), (301, "edge"), (599, "edge")]
    points += [(1000 + i, None) for i in range(7)]
    points += [(700 + 50 * i, "busy") for i in range(6)]
    events = edits(spark, points)
    wanted = windows.sliding_counts(events, 300, 10).where(F.col("recent_edits") >= at_least)
    found = windows.sliding_counts(events, 300, 10, at_least=at_least)
    columns = ("window_start", "title", "recent_edits")
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(found) == key(wanted) != []


def test_window_must_be_a_multiple_of_the_slide(spark):
    with pytest.raises(ValueError):
        windows.sliding_counts(edits(spark, []), 300, 7)


def test_results_do_not_depend_on_partitioning(spark):
    events = edits(spark, [(i % 97, f"t{i % 5}") for i in range(300)])
    wanted = rows(windows.trailing_counts(events, 30), "title", "timestamp", "edits", "trailing_edits")
    for parts in (1, 7):
        again = windows.trailing_counts(events.repartition(parts, F.rand(1)), 30)
        assert rows(again, "title", "timestamp", "edits", "trailing_edits") == wanted
