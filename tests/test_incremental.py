"""The batch layer over files that come bit by bit, against the same over all of them."""

from pathlib import Path

import pytest

from editpulse.jobs import batch
from editpulse.operators import history
from editpulse.plans import incremental
from editpulse.plans.batch_layer import batch_tables
from editpulse.plans.incremental import table_paths, update_batch_layer
from editpulse.sinks import CommitLog
from editpulse.sources import StoredBaseline
from helpers import edits

DAY = 86400
PARTS = [
    [(0, "a", "ann", False), (10, "a", "bob", True), (DAY, "b", None, None), (None, "a", "ann", False)],
    [(20, "a", "cid", False), (3600, "a", "ann", False), (2 * DAY, None, "ann", False)],
    [(5 * DAY, "c", "dan", True), (DAY + 1, "b", "dan", False), (None, "a", "eve", True)],
]


def put(spark, folder, i):
    edits(spark, PARTS[i]).coalesce(1).write.parquet(f"{folder}/in/part={i}")


def contents(spark, paths):
    return {name: sorted(map(str, spark.read.parquet(path).collect())) for name, path in paths.items()}


def expected(spark, upto):
    events = edits(spark, [r for part in PARTS[:upto] for r in part])
    return {name: sorted(map(str, t.collect())) for name, t in batch_tables(history.hour_rollup(events), events).items()}


def test_runs_over_new_files_only(spark, tmp_path):
    out = str(tmp_path / "out")
    for i in range(len(PARTS)):
        put(spark, tmp_path, i)
        paths = update_batch_layer(spark, f"{tmp_path}/in", out)
        assert contents(spark, paths) == expected(spark, i + 1)
        assert CommitLog(spark, f"{out}/commits").latest()[1]["files"] == 1
        # What was merged is not read again: its bytes could as well be gone.
        for file in Path(tmp_path, "in", f"part={i}").glob("part-*.parquet"):
            size = file.stat().st_size
            file.write_bytes(b"x" * size)
    assert update_batch_layer(spark, f"{tmp_path}/in", out) == table_paths(spark, out)
    assert CommitLog(spark, f"{out}/commits").latest()[0] == 2


def test_only_touched_dates_are_replaced_and_old_folders_go(spark, tmp_path):
    out = tmp_path / "out"
    for i in range(3):
        put(spark, tmp_path, i)
        update_batch_layer(spark, f"{tmp_path}/in", str(out))
    record = CommitLog(spark, f"{out}/commits").latest()[1]
    runs = {d: f.split("/")[1] for d, f in record["rollup"].items()}
    assert runs == {"2024-03-01": "run=1", "2024-03-02": "run=2", "2024-03-03": "run=1", "2024-03-06": "run=2", "none": "run=2"}
    left = lambda name: sorted(p.name for p in (out / name).glob("run=*"))
    assert left("fresh") == [] and left("titles") == ["run=1", "run=2"] and left("tables/summary") == ["run=1", "run=2"]
    assert left("inputs") == left("editors") == ["run=0", "run=1", "run=2"]


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    put(spark, tmp_path, 0)
    update_batch_layer(spark, f"{tmp_path}/in", out)
    put(spark, tmp_path, 1)
    with monkeypatch.context() as broken:
        broken.setattr(incremental, "six_tables", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            update_batch_layer(spark, f"{tmp_path}/in", out)
    assert contents(spark, table_paths(spark, out)) == expected(spark, 1)
    assert contents(spark, update_batch_layer(spark, f"{tmp_path}/in", out)) == expected(spark, 2)


def test_a_changed_file_is_an_error(spark, tmp_path):
    put(spark, tmp_path, 0)
    update_batch_layer(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    file = next(Path(tmp_path, "in", "part=0").glob("part-*.parquet"))
    file.write_bytes(file.read_bytes() + b"x")
    with pytest.raises(ValueError):
        update_batch_layer(spark, f"{tmp_path}/in", f"{tmp_path}/out")


def test_job(spark, tmp_path):
    for i in range(2):
        put(spark, tmp_path, i)
        paths = batch.main(["--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--format", "parquet", "--incremental"])
    assert contents(spark, paths) == expected(spark, 2)
    known = StoredBaseline(spark, f"{tmp_path}/out/probe")(spark.createDataFrame([("b",)], "title string"))
    assert ("b", 1.0) in [tuple(r) for r in known.collect()]
