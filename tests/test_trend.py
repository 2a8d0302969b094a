import pytest
from pyspark.sql import functions as F

from editpulse.config import Settings
from editpulse.operators import display, history, live, trend
from editpulse.plans import serving, speed_layer
from editpulse.schemas import BASELINE, SNAPSHOT
from helpers import at, edits, rows

COUNTS = "title string, recent_edits long"


def counts(spark, **by_title):
    return spark.createDataFrame(list(by_title.items()), COUNTS)


def baseline(spark, **by_title):
    return spark.createDataFrame(list(by_title.items()), BASELINE)


def ranked(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("rank").collect()]


def test_worked_example(spark):
    row = trend.trending(counts(spark, A=3), baseline(spark, A=4.67), 300).first()
    assert (row.current_edits_per_hour, row.baseline_edits_per_hour, row.trend_score) == (36.0, 4.67, 7.71)
    assert row.baseline_available and row["rank"] == 1


def test_scores_on_the_edge_of_rounding(spark):
    """1012 / 24 * 2124 / 60720 is 1.475; after three divisions it was 1.4749999999999999. 2277 / 24 / 75 is 1.265."""
    known = spark.createDataFrame(
        [("a", 60720 / 2124, 60720, 2124), ("b", 75.0, 58200, 776), ("c", None, None, None)],
        "title string, baseline_edits_per_hour double, baseline_edits long, baseline_hours long",
    )
    found = trend.trending(counts(spark, a=1012, b=2277, c=5), known, 86400)
    assert ranked(found, "title", "trend_score") == [("a", 1.48), ("b", 1.27), ("c", None)]


def test_baseline_with_its_sums(spark):
    events = edits(spark, [(0, "A"), (10, "A"), (3600, "A"), (0, "B")])
    assert rows(history.baseline_with_sums(events), "title", "baseline_edits_per_hour", "baseline_edits", "baseline_hours") == [
        ("A", 1.5, 3, 2), ("B", 1.0, 1, 1),
    ]


def test_rates_of_a_published_snapshot(spark):
    found = trend.trending(counts(spark, a=8, b=4, c=3, d=2), None, 300)
    assert ranked(found, "title", "current_edits_per_hour", "trend_score", "baseline_available") == [
        ("a", 96.0, None, False), ("b", 48.0, None, False), ("c", 36.0, None, False),
    ]


def test_unusable_baselines(spark):
    known = spark.createDataFrame([("a", 0.0), ("b", -1.0), ("c", None), (None, 2.0), ("d", 0.5)], BASELINE)
    found = trend.trending(counts(spark, a=5, b=4, c=3, d=3), known, 300)
    assert ranked(found, "title", "baseline_available") == [("d", True), ("a", False), ("b", False), ("c", False)]


def test_rank_uses_rounded_scores_then_edits_then_title(spark):
    known = baseline(spark, a=1.0, b=1.00001, c=2.0)
    found = trend.trending(counts(spark, b=3, a=3, c=6), known, 300)
    assert ranked(found, "title", "trend_score") == [("c", 36.0), ("a", 36.0), ("b", 36.0)]


def test_top_n_and_minimum(spark):
    many = spark.range(40).select(F.concat(F.lit("t"), "id").alias("title"), (F.col("id") % 7).alias("recent_edits"))
    assert trend.trending(many, None, 300).count() == 10
    assert trend.trending(many, None, 300, trend.RATE_ALL, top_n=50).count() == 40
    few = trend.trending(counts(spark, a=2, b=3, c=4), None, 300)
    assert ranked(few, "title") == [("c",), ("b",)]
    strict = trend.trending(counts(spark, a=2, b=3, c=4), None, 300, trend.COUNT)
    assert ranked(strict, "title", "trend_score") == [("c", 4.0)]


def test_ratio_policy(spark):
    known = baseline(spark, big=10.0, low=8.0, floor=0.5, above=0.51)
    n = counts(spark, big=5, low=3, floor=1, above=1, new=2, once=1)
    found = trend.trending(n, known, 600, trend.RATIO)
    assert ranked(found, "title", "baseline", "trend_score") == [
        ("new", 0.0, 2.0), ("above", 0.51, 1.9608), ("big", 10.0, 0.5),
    ]


def test_rate_all_policy_orders_missing_scores_by_rate(spark):
    found = trend.trending(counts(spark, a=1, b=2, c=1), baseline(spark, c=100.0), 300, trend.RATE_ALL)
    assert ranked(found, "title") == [("c",), ("b",), ("a",)]


def test_many_windows_at_once_equal_one_by_one(spark):
    events = edits(spark, [(i * 7 % 900, f"t{i * i % 11}") for i in range(600)])
    known = baseline(spark, t0=3.0, t1=9.0, t4=0.2)
    replay = speed_layer.trending_replay(events, known, 300, 60)
    start = replay.agg(F.min("window_start")).first()[0]
    for offset in (240, 300, 600):
        moment = F.lit(start) + F.make_dt_interval(secs=F.lit(offset))
        inside = events.where((F.col("timestamp") >= moment) & (F.col("timestamp") < moment + F.expr("INTERVAL 300 SECONDS")))
        single = trend.trending(inside.groupBy("title").agg(F.count("*").alias("recent_edits")), known, 300)
        assert ranked(replay.where(F.col("window_start") == moment), "title", "trend_score") == ranked(single, "title", "trend_score")


def test_snapshot_document(spark):
    events = edits(spark, [(i, "A") for i in range(4)] + [(5, "B"), (6, ""), (7, None)])
    document = speed_layer.snapshot_now(events, None, 300, generated_at=F.lit("now"))
    row = document.first()
    assert (row.total_events_in_window, row.distinct_articles_in_window, row.window_seconds) == (5, 2, 300)
    assert [a.title for a in row.trending_articles] == ["A"]
    assert [f.name for f in document.schema.fields] == SNAPSHOT.fieldNames()
    nothing = speed_layer.snapshot_now(edits(spark, []), None, 300, generated_at=F.lit("now")).first()
    assert (nothing.total_events_in_window, nothing.trending_articles) == (0, [])


def test_live_view(spark):
    events = edits(spark, [(0, "A"), (1, "A", "bob"), (2, "B", "bob")]).withColumn("anonymous", F.col("title") == "B")
    row = serving.live_view(events, None, 600).first()
    assert (row.total_events, row.unique_editors, row.active_articles) == (3, 2, 2)
    assert (row.anonymous_ratio, row.events_per_second) == (0.3333, 0.005)
    assert [(a.title, a.baseline, a.trend_score) for a in row.trending_articles] == [("A", 2.0, 1.0), ("B", 1.0, 1.0)]
    empty = serving.live_view(edits(spark, []), None, 600).first()
    assert (empty.total_events, empty.anonymous_ratio, empty.events_per_second, empty.trending_articles) == (0, 0.0, 0.0, [])


def test_display(spark):
    scored = trend.score(counts(spark, a=3, b=4), baseline(spark, a=4.67), 300)
    shown = [tuple(r) for r in display.display_trending(scored).collect()]
    assert shown == [("a", 3, 36.0, "4.67", "7.71×"), ("b", 4, 48.0, "No historical data", "N/A")]
    with pytest.raises(ValueError, match="trend_score"):
        display.display_trending(scored.drop("trend_score"))


def test_recent_events(spark):
    events = edits(spark, [(i, f"t{i:03}") for i in range(250)])
    newest = display.recent_events(events, 3).collect()
    assert [r.title for r in newest] == ["t249", "t248", "t247"]
    assert newest[0].timestamp == "2024-03-01T12:04:09+00:00"
    assert display.recent_events(events, 200).count() == 200
    for n in (0, 201):
        with pytest.raises(ValueError):
            display.recent_events(events, n)


def test_settings_change_the_rules(spark):
    loose = Settings(min_edits=1, trending_top_n=1)
    assert ranked(trend.trending(counts(spark, a=1, b=2), None, 300, settings=loose), "title") == [("b",)]


def test_window_totals_of_nothing(spark):
    assert tuple(live.window_totals(spark.createDataFrame([], COUNTS)).first()) == (0, 0)
    assert at(0) < at(1) and rows(counts(spark, a=1), "title") == [("a",)]
