import pytest

import __spark_entry__ as contract
import oracle
from editpulse.operators import history, windows
from editpulse.operators.trend import COUNT
from editpulse.plans import speed_layer

SF = contract.SMALLEST


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(contract.edit_queries()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(contract.edit_queries()))
def test_query_matches_sql(spark, con, name):
    found = oracle.differences(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name])
    assert found == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_bound_reaches_the_scan(spark):
    text = windows.trailing(contract.edits(spark, SF), 300).select("title")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(ts,ScalarSubquery" in text


def test_stored_dates_are_pruned(spark, tmp_path):
    events = contract.zoned(contract.edits(spark, SF))
    history.with_event_times(events).withColumnRenamed("edit_date", "event_date").write.partitionBy("event_date").parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert "PartitionFilters: [isnotnull(event_date" in plan(windows.trailing(stored, 300))


def test_only_the_columns_needed_are_read(spark):
    assert "ReadSchema: struct<ts:timestamp_ntz,props:string>" in plan(history.article_baseline(contract.edits(spark, SF)))


def test_no_event_is_copied_for_distinct_counts(spark):
    assert "Expand" not in plan(contract.queries()["live_metrics"](spark, SF))


def test_health_reads_the_records_once(spark):
    assert plan(contract.queries()["health_view"](spark, SF)).count("FileScan") == 1


def test_window_ranking_is_cut_before_the_shuffle(spark):
    ranked = speed_layer.trending_replay(contract.edits(spark, SF), None, 86400, 21600, COUNT)
    text = plan(ranked)
    assert "row_number(), 10, Partial" in text and "row_number(), 10, Final" in text


def test_no_query_needs_a_cartesian_product_or_python_rows(spark):
    for name, query in contract.edit_queries().items():
        if name.startswith(("stream", "batch_layer", "stored", "landing")):
            continue
        text = plan(query(spark, SF))
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInArrow"):
            assert operator not in text, (name, operator)
