import ipaddress
import itertools
import random

from pyspark.sql import functions as F

from editpulse.functions import bucket_offset_minutes, hourly_rate, is_ip_address, looks_anonymous, share, to_iso
from helpers import at


def is_valid(text):
    try:
        ipaddress.ip_address(text)
        return True
    except ValueError:
        return False


def address_texts():
    rng = random.Random(5)
    groups = ["", "0", "1", "ffff", "ABCD", "12345", "g", "1.2.3.4", "256.1.1.1"]
    texts = {":".join(p) for n in range(1, 4) for p in itertools.product(groups, repeat=n)}
    for _ in range(6000):
        texts.add(":".join(rng.choice(groups) for _ in range(rng.randint(1, 10))))
    octets = ["0", "1", "9", "10", "99", "100", "199", "200", "249", "250", "255", "256", "300", "01", "", "a", "-1"]
    for _ in range(4000):
        texts.add(".".join(rng.choice(octets) for _ in range(rng.randint(1, 5))))
    texts |= {f"fe80::1%{zone}" for zone in ("eth0", "", "a%b")} | {"::", ":::", "::1", "1::", "1::2::3", "1.2.3.4%x"}
    return sorted(texts)


def test_addresses_agree_with_the_standard_library(spark):
    frame = spark.createDataFrame([(t,) for t in address_texts()], "t string")
    wrong = [(r.t, r.ok) for r in frame.select("t", is_ip_address(F.col("t")).alias("ok")).collect() if r.ok != is_valid(r.t)]
    assert wrong == []


def test_anonymous_users(spark):
    cases = {
        "~2026-1": True, "  ~x": True, " 10.0.0.1\t": True, "10.0.0.1/24": True, "2001:db8::/32": True,
        "": False, "   ": False, None: False, "Ann": False, "10.0.0.1 /24": False, "a~b": False,
    }
    frame = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.a for r in frame.select("u", looks_anonymous(F.col("u")).alias("a")).collect()} == cases


def test_rates_and_shares(spark):
    row = spark.range(1).select(
        hourly_rate(F.lit(3), 300).alias("a"), hourly_rate(F.lit(3), 0).alias("b"), hourly_rate(F.lit(1), 86400).alias("c"),
        share(F.lit(1), F.lit(3)).alias("d"), share(F.lit(1), F.lit(0)).alias("e"),
    ).first()
    assert (row.a, row.b, row.d, row.e) == (36.0, 36.0, 0.3333, 0.0)
    assert abs(row.c - 1 / 24) < 1e-15


def test_iso_text(spark):
    frame = spark.createDataFrame([(at(0),), (at(0.5),), (at(1e-6),)], "t timestamp")
    assert [r[0] for r in frame.select(to_iso(F.col("t"))).collect()] == [
        "2024-03-01T12:00:00+00:00", "2024-03-01T12:00:00.500000+00:00", "2024-03-01T12:00:00.000001+00:00",
    ]


def test_bucket_offsets():
    assert [bucket_offset_minutes(n) for n in (5, 10, 15, 30, 60)] == [0] * 5
    assert bucket_offset_minutes(7) == 15780960 % 7
