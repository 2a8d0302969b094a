import pytest

from editpulse.operators import filters, history
from helpers import edits, rows

HOUR = 3600
EVENTS = [
    (0, "A"), (10, "A", "bob"), (HOUR, "A", "bob", True), (5 * HOUR, "A"),
    (20, "B", "cy"), (30, "B", "cy", None), (40, "C", None),
]


def test_counts_and_order(spark):
    events = edits(spark, EVENTS)
    assert [tuple(r) for r in history.top_articles(events, 2).collect()] == [("A", 4), ("B", 2)]
    assert rows(history.bot_counts(events.where("bot is not null")), "bot", "edit_count") == [(False, 5), (True, 1)]
    assert history.bot_counts(events).count() == 3
    assert tuple(history.bot_vs_human(events).first()) == (1, 6)
    assert [r.edit_count for r in history.hourly_counts(events).collect()] == [5, 1, 1]
    assert tuple(history.totals(events).first()) == (7, 3, 3)


def test_ties_follow_the_title(spark):
    events = edits(spark, [(0, "b"), (0, "a"), (0, "c")])
    assert [r.title for r in history.top_articles(events, 2).collect()] == ["a", "b"]


def test_baseline_counts_active_hours_only(spark):
    events = edits(spark, EVENTS)
    expected = [("A", 4 / 3), ("B", 2.0), ("C", 1.0)]
    assert rows(history.article_baseline(events), "title", "baseline_edits_per_hour") == expected
    both = history.baseline_for(events, events.select("title").distinct())
    assert rows(both, "title", "baseline_edits_per_hour") == [(t, round(b, 4)) for t, b in expected]
    listed = history.baseline_for(events, ["A", "Z"])
    assert rows(listed, "title", "baseline_edits_per_hour") == [("A", 1.3333)]


def test_missing_hours(spark):
    events = edits(spark, [(None, "A"), (None, "A"), (0, "A"), (None, "B")])
    assert rows(history.article_baseline(events), "title", "baseline_edits_per_hour") == [("A", 1.5), ("B", 1.0)]
    assert rows(history.baseline_for(events, ["A", "B"]), "title", "baseline_edits_per_hour") == [("A", 3.0), ("B", 1.0)]


def test_rollup_gives_the_same_tables(spark):
    events = edits(spark, EVENTS)
    rollup = history.hour_rollup(events)
    for table in (history.article_counts, history.bot_counts, history.namespace_counts, history.hourly_counts,
                  history.article_hours, history.article_baseline):
        direct, rolled = table(events), table(rollup)
        assert sorted(map(str, direct.collect())) == sorted(map(str, rolled.collect())), table.__name__
    assert history.totals(rollup, events).first() == history.totals(events).first()


def test_empty_history(spark):
    events = edits(spark, [])
    assert tuple(history.totals(events).first()) == (0, 0, 0)
    assert tuple(history.bot_vs_human(events).first()) == (0, 0)
    assert history.article_baseline(events).count() == 0


def test_buckets(spark):
    events = edits(spark, [(i * 60, "A") for i in range(30)])
    newest = history.edit_rate_buckets(events, 5, 3).collect()
    assert [r["count"] for r in newest] == [5, 5, 5]
    assert [r.bucket for r in newest] == sorted(r.bucket for r in newest)
    for minutes, limit in ((0, 1), (61, 1), (5, 0), (5, 501)):
        with pytest.raises(ValueError):
            history.edit_rate_buckets(events, minutes, limit)


def test_long_title_lists_become_a_join(spark):
    events = edits(spark, [(0, f"t{i}") for i in range(5)])
    many = [f"t{i}" for i in range(3, 2000)]
    assert rows(filters.only_titles(events, many), "title") == [("t3",), ("t4",)]
