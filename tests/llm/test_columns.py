"""The columns of registered queries against plain versions, on small tables."""

import hashlib
import zlib
from collections import Counter

import pytest

from editpulse.llm import registry, sharding
from test_operators import spans_of

SF = "/root/testdata/sf0.01"
KINDS = ("assign", "access", "hex")


def place_of(number, n, seed):
    """The Feistel network and its cycle walk, one number at a time."""
    a, b = sharding.halves_of(n)
    while True:
        left, right = divmod(number, b)
        for r, (k, m, s) in enumerate(sharding.keys_of(seed)):
            of = lambda v: (v * k + m) % sharding.P * s % sharding.Q
            if r % 2 == 0:
                left = (left + of(right)) % a
            else:
                right = (right + of(left)) % b
        number = left * b + right
        if number < n:
            return number


def expected_shards(rows, shards, seed):
    """rows: (doc_id, text). Rows that agree in all they are told apart by come in any order."""
    keyed = sorted(
        (hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), (i is not None, i or 0), zlib.crc32(t.encode()), len(t.encode()) + 16, i)
        for i, t in ((i, t or "") for i, t in rows)
    )
    places = [place_of(rank, len(keyed), seed) for rank in range(len(keyed))]
    return Counter((i, size, crc, "rows", p % shards, p // shards, None) for (_, _, crc, size, i), p in zip(keyed, places))


@pytest.mark.parametrize("shards,seed", [(7, 2), (40, 5)])
def test_shards_follow_the_permutation(docs, raw, shards, seed):
    assert Counter(tuple(r) for r in sharding.shard_rows(docs, shards, seed).collect()) == expected_shards([r[:2] for r in raw], shards, seed)


def test_shard_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in registry.QUERIES["op2_feistel_shards"](spark, SF).collect()) == expected_shards(rows, 40, 2)


def test_secret_query(spark):
    found = {r.doc_id: r for r in registry.QUERIES["op4_secrets"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        base = sorted(spans_of(text))
        written = [f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in base]
        r = found[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(kind == k for _, kind, _ in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random:")] == written
    assert any(r.n_assign + r.n_access + r.n_hex for r in found.values())
