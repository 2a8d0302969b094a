import json
from datetime import datetime, timezone

import pytest

from editpulse.config import Settings
from editpulse.operators import normalise as N
from editpulse.streaming.ingest import ingest_batch

GOOD = {
    "timestamp": 1709294400, "title": "Lake Vostok", "user": "Orla", "anonymous": False,
    "bot": False, "comment": "spelling", "type": "edit", "namespace": 0, "wiki": "enwiki",
    "server_name": "en.example.org",
}
MOMENT = datetime(2024, 3, 1, 12, 0, tzinfo=timezone.utc)


def changed(**fields):
    return json.dumps({**GOOD, **fields})


def without(*names):
    return json.dumps({k: v for k, v in GOOD.items() if k not in names})


def run(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return [r for r in N.normalise(frame).orderBy("i").collect()]


# (record, rejected because of)
REJECTED = [
    ("", "not_a_json_object"),
    ("not json", "not_a_json_object"),
    ('["a"]', "not_a_json_object"),
    ("5", "not_a_json_object"),
    ("null", "not_a_json_object"),
    (json.dumps(GOOD) + json.dumps(GOOD), "not_a_json_object"),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), "not_a_json_object"),
    (json.dumps(GOOD)[:-5], "not_a_json_object"),
    (without("title"), "title"),
    (changed(title=None), "title"),
    (changed(title=""), "title"),
    (changed(title=5), "title"),
    (changed(user=None), "user"),
    (changed(user=7), "user"),
    (changed(type=None), "event_type"),
    (changed(wiki=None), "wiki"),
    (changed(namespace=None), "namespace"),
    (changed(namespace="1.5"), "namespace"),
    (changed(namespace="x"), "namespace"),
    (changed(namespace=[]), "namespace"),
    (without("timestamp"), "timestamp"),
    (changed(timestamp=None), "timestamp"),
    (changed(timestamp="yesterday"), "timestamp"),
    (changed(timestamp="2024-05"), "timestamp"),
    (changed(timestamp="10d"), "timestamp"),
    (changed(timestamp="nan"), "timestamp"),
    (changed(timestamp=1e15), "timestamp"),
    (changed(timestamp=[1]), "timestamp"),
    (changed(meta="text"), "meta"),
    (changed(meta=3), "meta"),
    (changed(meta={"domain": None}), "server_name"),
    (changed(meta={"domain": 4}), "server_name"),
    (changed(server_name=None), "server_name"),
]


def test_rejections(spark):
    found = run(spark, [text for text, _ in REJECTED])
    assert [(r.value, r.reject_reason) for r in found] == REJECTED


# (record, field, value)
KEPT = [
    (json.dumps(GOOD), "timestamp", MOMENT),
    (changed(timestamp="1709294400"), "timestamp", MOMENT),
    (changed(timestamp=1709294400.25), "timestamp", MOMENT.replace(microsecond=250000)),
    (changed(timestamp="2024-03-01T12:00:00Z"), "timestamp", MOMENT),
    (changed(timestamp="2024-03-01T14:00:00+02:00"), "timestamp", MOMENT),
    (changed(timestamp="2024-03-01T12:00:00"), "timestamp", MOMENT),
    (changed(timestamp="2024-03-01 12:00:00.123456"), "timestamp", MOMENT.replace(microsecond=123456)),
    (changed(timestamp="2024-03-01"), "timestamp", MOMENT.replace(hour=0)),
    (without("user"), "user", "unknown"),
    (changed(user=""), "user", ""),
    (without("comment"), "comment", ""),
    (changed(comment=None), "comment", ""),
    (changed(comment=5), "comment", ""),
    (without("type"), "event_type", "edit"),
    (without("wiki"), "wiki", ""),
    (without("namespace"), "namespace", 0),
    (changed(namespace="4"), "namespace", 4),
    (changed(namespace=" -2 "), "namespace", -2),
    (changed(namespace=1.7), "namespace", 1),
    (changed(namespace=True), "namespace", 1),
    (without("server_name"), "server_name", ""),
    (changed(meta={"domain": "a.example"}), "server_name", "a.example"),
    (changed(meta={"id": 1}), "server_name", "en.example.org"),
    (changed(meta=None), "server_name", "en.example.org"),
    (changed(meta=0), "server_name", "en.example.org"),
    (changed(bot="false"), "bot", True),
    (changed(bot=""), "bot", False),
    (changed(bot=0), "bot", False),
    (changed(bot=0.0), "bot", False),
    (changed(bot=2), "bot", True),
    (changed(bot=[]), "bot", False),
    (changed(bot=[0]), "bot", True),
    (changed(bot={}), "bot", False),
    (changed(bot=None), "bot", False),
    (without("bot"), "bot", False),
    (changed(anonymous=True), "anonymous", True),
    (changed(user="~2031-77-5"), "anonymous", True),
    (changed(user="192.0.2.1"), "anonymous", True),
    (changed(user="2001:db8::/32"), "anonymous", True),
    (changed(user="1.2.3"), "anonymous", False),
    (changed(user="010.0.0.1"), "anonymous", False),
    (without("user"), "anonymous", False),
    ('{"title": "first", ' + changed(title="last")[1:], "title", "last"),
    (changed(title="日本語 \"quoted\" \\ slash"), "title", "日本語 \"quoted\" \\ slash"),
]


def test_kept_values(spark):
    found = run(spark, [text for text, _, _ in KEPT])
    for row, (text, field, value) in zip(found, KEPT):
        assert row.reject_reason is None, (text, row.reject_reason)
        got = row.event[field]
        if isinstance(got, datetime):
            got = got.astimezone(timezone.utc)
        assert got == value, (text, field, got)


def test_counters_and_split(spark):
    texts = [json.dumps(GOOD), changed(bot=True), changed(namespace=1), changed(wiki="dewiki"), "{", changed(title="")]
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    row = N.ingest_counters(N.normalise(frame)).first()
    assert (row.total_received, row.total_accepted, row.total_filtered, row.total_parse_errors) == (4, 1, 3, 2)
    assert row.drop_rate == 1.25 and row.reject_share == pytest.approx(0.8333)

    events, rejects = ingest_batch(frame)
    assert events.count() == 1 and rejects.count() == 2
    loose, _ = ingest_batch(frame, Settings(exclude_bots=False, wiki=""))
    assert loose.count() == 3


def test_counters_of_nothing_are_zero(spark):
    row = N.ingest_counters(N.normalise(spark.createDataFrame([], "value string"))).first()
    assert tuple(row) == (0, 0, 0, 0, 0.0, 0.0)


def test_title_extraction(spark):
    data = [
        b'{"title": "A"}', b'{"title": "0"}', b'{"title": 0}', b'{"title": 5}', b'{"title": null, "page_title": "B"}',
        b'{"title": "", "page_title": "C"}', b'{"page_title": ""}', b"[]", b"", b'{"title": "x\xff"}',
    ]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, data binary")

    def titles(**options):
        return {r.i: r.title for r in N.extract_titles(frame, **options).collect()}

    assert titles() == {0: "A", 1: "0", 3: "5", 9: "x�"}
    assert titles(fallback_key="page_title", replace_bad_bytes=False) == {0: "A", 1: "0", 3: "5", 4: "B", 5: "C"}
