import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from editpulse.operators import display
from editpulse.operators.rates import ingest_metrics, ingest_rate, rate_rollup, speedup
from editpulse.plans import serving
from editpulse.plans.batch_layer import run_batch_layer
from editpulse.schemas import BASELINE, BATCH_TABLES
from editpulse.session import run_folder
from editpulse.sources import read_baseline, read_event_json, read_parts, read_snapshot, union_parts
from editpulse.sources.tables import create_event_table
from helpers import edits, rows


def test_missing_baseline_is_empty(spark, tmp_path):
    assert read_baseline(spark, None).count() == 0
    assert read_baseline(spark, str(tmp_path / "absent")).schema == BASELINE
    (tmp_path / "empty").mkdir()
    assert read_baseline(spark, str(tmp_path / "empty")).count() == 0


def test_other_baseline_failures_are_errors(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "wrong"))
    with pytest.raises(AnalysisException):
        read_baseline(spark, str(tmp_path / "wrong"))


def test_baseline_values(spark, tmp_path):
    path = str(tmp_path / "b")
    spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", -1.0), ("d", None), (None, 1.0)], BASELINE).write.parquet(path)
    assert rows(read_baseline(spark, path), "title") == [("a",)]
    assert rows(read_baseline(spark, path, positive_only=False), "title") == [("a",), ("b",), ("c",)]


def test_parts(spark, tmp_path):
    assert read_parts(spark, str(tmp_path / "absent"), BASELINE).count() == 0
    spark.createDataFrame([("a", 1.0)], BASELINE).write.parquet(str(tmp_path / "t/x"))
    spark.createDataFrame([("b", 2.0)], BASELINE).write.parquet(str(tmp_path / "t/y"))
    assert rows(read_parts(spark, str(tmp_path / "t"), BASELINE), "title") == [("a",), ("b",)]
    one, two = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2,)], "a int")
    assert sorted(map(tuple, union_parts([one, two, two]).collect())) == [(1, "x"), (2, None), (2, None)]


def test_no_snapshot_yet(spark, tmp_path):
    assert read_snapshot(spark, str(tmp_path / "absent")).count() == 0


def test_bus_payload_round_trip(spark, tmp_path):
    events = edits(spark, [(0, "A" * 300), (0.25, 'q"uote', None), (1, "")])
    bus = display.bus_rows(events)
    assert sorted(len(r.key) for r in bus.collect()) == [6, 7, 256]
    path = str(tmp_path / "lines")
    bus.select("value").write.text(path)
    back = read_event_json(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, events.collect()))


def test_batch_layer_from_both_formats(spark, tmp_path):
    events = edits(spark, [(i * 600, f"t{i % 4}", f"u{i % 3}", i % 2 == 0) for i in range(50)])
    direct = run_batch_layer(spark, events, str(tmp_path / "a"))
    assert set(direct) == set(BATCH_TABLES)
    display.bus_rows(events).select("value").write.text(str(tmp_path / "json/2024/03"))
    text = read_event_json(spark, str(tmp_path / "json"))
    again = run_batch_layer(spark, text, str(tmp_path / "b"), columnar_input=False)
    for name in BATCH_TABLES:
        one, two = spark.read.parquet(direct[name]), spark.read.parquet(again[name])
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())), name
    views = serving.stored_views(spark, str(tmp_path / "a"))
    assert tuple(views["summary"].first()) == (50, 4, 3)
    assert [r.title for r in views["top_articles"].collect()] == ["t0", "t1", "t2", "t3"]
    assert views["article_baseline"].columns == ["Article", "Historical Edits/Hour"]
    assert {k: v.count() for k, v in serving.stored_views(spark, str(tmp_path / "none")).items()} == dict.fromkeys(views, 0)


def test_event_table_is_created_once(spark, tmp_path):
    name = "events_" + run_folder(spark, "x").rsplit("-", 1)[-1]
    create_event_table(spark, name, str(tmp_path / "events"))
    create_event_table(spark, name, str(tmp_path / "events"))
    assert spark.table(name).count() == 0
    found = serving.query(spark, f"select count(*) as n from {name} where title = ?", ["A"])
    assert found.first().n == 0
    spark.sql(f"DROP TABLE {name}")


def test_event_table_shows_what_is_stored(spark, tmp_path):
    name, path = "events_" + run_folder(spark, "x").rsplit("-", 1)[-1], str(tmp_path / "events")
    for k, points in enumerate([[(0, "A")], [(1, "A"), (86400, "B")]]):
        dated = edits(spark, points).withColumn("event_date", F.to_date("timestamp"))
        dated.write.mode("append").partitionBy("event_date").parquet(path)
        create_event_table(spark, name, path)
        assert spark.table(name).count() == (1, 3)[k]
    newest = spark.table(name).where("event_date = (select max(event_date) from " + name + ")")
    assert rows(newest, "title") == [("B",)]
    spark.sql(f"DROP TABLE {name}")


def test_rates(spark):
    events = edits(spark, [(i, "A") for i in (0, 1, 9, 10, 299, 300)])
    rate = ingest_rate(events)
    assert rows(rate, "events_published", "events_per_second") == [(1, 0.1), (1, 0.1), (1, 0.1), (3, 0.3)]
    rolled = rows(rate_rollup(rate), "average_eps", "maximum_eps")
    assert rolled == [(0.1, 0.1), (pytest.approx(0.5 / 3), 0.3)]
    assert ingest_metrics(rate).count() == 8
    runs = spark.createDataFrame([(1, 80.055), (2, 78.075)], "executors int, runtime_seconds double")
    assert [round(r.speedup, 3) for r in speedup(runs).orderBy("executors").collect()] == [1.0, 1.025]


def test_health(spark):
    from editpulse.operators.normalise import normalise

    good = '{"timestamp": 1709294400, "title": "A", "wiki": "enwiki"}'
    late = '{"timestamp": 1709294500, "title": "A", "wiki": "enwiki"}'
    frame = spark.createDataFrame([(good,), (late,), ("x",)], "value string")
    row = serving.health_view(normalise(frame), 60, now=F.lit("2024-03-01 12:02:00").cast("timestamp")).first()
    assert (row.total_received, row.total_parse_errors, row.events_in_window, row.seconds_since_last_event) == (2, 1, 1, 20.0)
