"""Closed dates of the store in few files: the same rows before and after, and when a run dies."""

import pytest
from pyspark.sql import functions as F

from editpulse.jobs import compact
from editpulse.schemas import EVENT
from editpulse.sinks import compact_store, read_store
from editpulse.sinks.commits import CommitLog
from editpulse.sources import read_stream
from editpulse.streaming import store_stream
from helpers import rows
from test_streaming import add

DAY = 86400


def flush(spark, folder, points, name):
    source = add(spark, folder, points, name)
    stream = read_stream(spark, source, EVENT, per_trigger=1)
    store_stream(stream, str(folder / "events"), str(folder / "cp"), None).awaitTermination()
    return str(folder / "events")


def titles(spark, store):
    return rows(read_store(spark, store), "title", "event_date")


def files(spark, store, date):
    return {r[0] for r in read_store(spark, store).where(F.col("event_date") == date).select(F.input_file_name()).distinct().collect()}


def test_dates_are_merged_and_late_edits_are_kept(spark, tmp_path, monkeypatch):
    store = ""
    for i in range(4):
        store = flush(spark, tmp_path, [(i, f"a{i}"), (DAY + i, f"b{i}")], str(i))
    whole = titles(spark, store)
    assert len(whole) == 8 and len(files(spark, store, "2024-03-01")) == 4
    assert compact_store(spark, store, "2024-03-02") == ["2024-03-01"]
    assert titles(spark, store) == whole
    assert len(files(spark, store, "2024-03-01")) == 1 and len(files(spark, store, "2024-03-02")) == 4
    assert compact_store(spark, store, "2024-03-02") == []

    flush(spark, tmp_path, [(50, "late"), (2 * DAY, "c")], "5")
    whole = titles(spark, store)
    assert len(whole) == 10 and len(files(spark, store, "2024-03-01")) == 2
    with monkeypatch.context() as broken:
        broken.setattr(CommitLog, "put", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            compact_store(spark, store, "2024-03-03")
    assert titles(spark, store) == whole and len(files(spark, store, "2024-03-01")) == 2
    assert compact.main(["--store", store, "--before", "2024-03-03"]) == ["2024-03-01", "2024-03-02"]
    assert titles(spark, store) == whole
    assert [len(files(spark, store, f"2024-03-0{d}")) for d in (1, 2, 3)] == [1, 1, 1]
    # The stream goes on, and its own readers see every edit once.
    flush(spark, tmp_path, [(3 * DAY, "d")], "6")
    assert spark.read.parquet(store).count() == 11 and len(titles(spark, store)) == 11


def test_nothing_to_merge(spark, tmp_path):
    store = flush(spark, tmp_path, [(0, "a")], "0")
    assert compact_store(spark, store, "2024-03-01") == []
    assert titles(spark, store)[0][0] == "a"
