import json
import random

import pytest

from editpulse.jobs import repair
from editpulse.sources import read_landing, split_landing, split_large
from helpers import rows

A = {"title": "A", "comment": "}{ in a string \" and a brace }"}
B = {"title": "日本", "n": [1, {"x": None}]}


def put(folder, name, text):
    path = folder / "2024" / "03" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_back_to_back_values(spark, tmp_path):
    put(tmp_path, "one", json.dumps(A) + json.dumps(B, ensure_ascii=False))
    put(tmp_path, "two", f"\n {json.dumps(B)} \t\n{json.dumps(A)}\n")
    put(tmp_path, "lines", json.dumps(B, indent=2) + "\n" + json.dumps(A, indent=1))
    put(tmp_path, "blank", " \n ")
    put(tmp_path, "cut", json.dumps(A) + json.dumps(B)[:-3])
    split = split_landing(read_landing(spark, str(tmp_path))).collect()
    by_file = {}
    for r in sorted(split, key=lambda r: (r.path, r.position)):
        by_file.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert {k: [json.loads(r.record) for r in v if r.error is None] for k, v in by_file.items()} == {
        "one": [A, B], "two": [B, A], "lines": [B, A], "cut": [A],
    }
    assert {k: [r.position for r in v] for k, v in by_file.items()} == dict.fromkeys(by_file, [0, 1])
    broken = [r for r in split if r.error]
    assert [(r.path.rsplit("/", 1)[1], r.position, r.record) for r in broken] == [("cut", 1, json.dumps(B)[:-3])]


def test_many_values_in_one_object(spark, tmp_path):
    put(tmp_path, "big", "".join(json.dumps({"i": i}) for i in range(10000)))
    split = split_landing(read_landing(spark, str(tmp_path)))
    assert split.where("error is null").selectExpr("sum(cast(get_json_object(record, '$.i') as long)) s", "count(*) n").first() == (
        sum(range(10000)), 10000,
    )


def test_repair_job(spark, tmp_path):
    put(tmp_path / "in", "one", json.dumps(A) + json.dumps(B))
    put(tmp_path / "in", "two", json.dumps(A) + "{")
    repair.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")])
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/lines")).collect()]
    assert sorted(lines, key=str) == sorted([A, A, B], key=str)
    assert rows(spark.read.parquet(str(tmp_path / "out/rejects")), "record") == [("{",)]
    assert json.loads((tmp_path / "in/2024/03/one").read_text()[: len(json.dumps(A))]) == A


def anything(draw, depth=0):
    """Text that braces, quotes and escapes may stand in anywhere."""
    kind = draw.randrange(5 if depth < 3 else 3)
    if kind < 2:
        return "".join(draw.choice('{}[]":, \\\n/aé東') for _ in range(draw.randrange(12)))
    if kind == 2:
        return draw.choice([None, True, -1.5, 10**20])
    if kind == 3:
        return [anything(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {anything(draw, 3) if draw.random() < 0.5 else "k": anything(draw, depth + 1) for _ in range(draw.randrange(4))}


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("block", [31, 400])
def test_large_objects_are_cut_within(spark, tmp_path, small_blocks, block):
    """The same values, wherever blocks begin: within strings, behind escapes, between values."""
    draw = random.Random(block)
    for i in range(3):
        values = [{str(k): anything(draw)} for k in range(draw.randrange(1, 6))]
        values += [anything(draw) for _ in range(3)]
        draw.shuffle(values)
        gaps = [draw.choice(["", " ", "\n", "\r\n"]) for _ in values]
        text = "".join((" " if isinstance(v, (int, float)) or v is None else "") + json.dumps(v, ensure_ascii=i % 2 > 0, indent=draw.choice([None, 1])) + (g or " " * isinstance(v, (int, float))) for v, g in zip(values, gaps))
        put(tmp_path / "in", f"o{i}", text)
    put(tmp_path / "in", "blank", " \n ")
    put(tmp_path / "in", "cut", json.dumps(A) * 3 + json.dumps(B)[:-1])
    put(tmp_path / "in", "open", json.dumps(A) + ' {"a": "}')
    small_blocks(2**27)
    expected = split_landing(read_landing(spark, str(tmp_path / "in"))).collect()
    small_blocks(block)
    found = split_large(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    key = lambda r: (r.path, r.position, r.record, r.error is None)
    assert sorted(map(key, found.collect())) == sorted(map(key, expected))
    assert spark.read.parquet(str(tmp_path / "work/pieces")).selectExpr("count(distinct path, block)").first()[0] > 5


def test_values_behind_a_broken_one(spark, tmp_path, small_blocks):
    put(tmp_path / "in", "x", json.dumps(A) + "{oops}" + json.dumps(B, ensure_ascii=False) * 2)
    small_blocks(16)
    found = sorted(split_large(spark, str(tmp_path / "in"), str(tmp_path / "work")).collect(), key=lambda r: r.position)
    assert [r.record for r in found] == [json.dumps(A), "{oops}"] + [json.dumps(B, ensure_ascii=False)] * 2
    assert [r.error is None for r in found] == [True, False, False, False] and found[-1].error == "after a broken value"


def test_values_are_kept_as_written(spark, tmp_path):
    put(tmp_path, "x", '{"a":1.50,"a":1e2} [1,\n2]')
    records = [r.record for r in split_landing(read_landing(spark, str(tmp_path))).collect()]
    assert records == ['{"a":1.50,"a":1e2}', "[1, 2]"]
