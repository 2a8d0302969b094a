"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
import oracle
from editpulse.llm import registry

SF = contract.SMALLEST


def test_all_are_registered():
    assert set(registry.QUERIES) <= set(contract.queries())
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.SQL[name]) == []


@pytest.mark.parametrize("small", [False, True])
def test_pipeline(spark, docs, empty, tmp_path, small):
    """All stages on rows of all kinds, and on an empty table."""
    current = empty if small else docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, current, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns, name
        found.write.parquet(str(tmp_path / str(k)))
        current = spark.read.parquet(str(tmp_path / str(k)))
    assert (current.count() == 0) or not small


def test_pipeline_on_the_smallest_data(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096
