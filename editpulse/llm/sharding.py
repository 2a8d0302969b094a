"""Reproducible global shuffle into shards (operator 2).

Every row gets a global row number, its rank by (md5 of doc_id, doc_id, text).
A Feistel network permutes the numbers 0..n-1, and the permuted number gives
shard and slot by division. Nobody needs the rows before: shard and slot follow
from the row number, the row count and the seed.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from editpulse.llm.common import documents, whole
from editpulse.session import configure

#: Two primes below 2**31: products of two residues fit into a long.
P, Q = 2147483647, 2147483629
ROUNDS, WALKS = 6, 64


def keys_of(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, P), draw.randrange(P), draw.randrange(1, Q)) for _ in range(rounds)]


def halves_of(n: int) -> tuple[int, int]:
    """a and b with a * b >= n and less than a numbers beyond n."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def quotient(x: Column, b: int) -> Column:
    return F.call_function("div", x, F.lit(b))


def feistel(x: Column, a: int, b: int, keys: list[tuple[int, int, int]]) -> Column:
    """One application: a bijection of 0..a*b-1."""
    left, right = quotient(x, b), x % b
    for r, (k, m, s) in enumerate(keys):
        of = lambda v, k=k, m=m, s=s: (v * F.lit(k) + F.lit(m)) % F.lit(P) * F.lit(s) % F.lit(Q)
        if r % 2 == 0:
            left = (left + of(right)) % a
        else:
            right = (right + of(left)) % b
    return left * b + right


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of a row number; walks the cycle until it is below n.

    Fewer than sqrt(n) numbers lie beyond n, so one step nearly always does. A
    walk can't be longer than that count, which is at most WALKS for n up to
    WALKS squared; beyond, a longer one has a chance below n ** (-WALKS / 2), and
    is reported as an error, never answered wrongly.
    """
    (a, b), keys = halves_of(n), keys_of(seed)
    first = feistel(number, a, b, keys)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(feistel(x, a, b, keys))
    )
    found = F.when(first < n, first).otherwise(walked)
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("the cycle walk did not end; take another seed")).cast("long"))


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: counts of shards differ by one at most. A null text is empty
    (size 16, crc 0). Rows are told apart by all they have here, so null or
    repeated doc_ids each get a place of their own; rows that agree in doc_id,
    size and text share their places in any order. Other columns are ignored;
    an empty table gives no rows.
    """
    raw = whole().cast("binary")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    n_rows = docs.select(F.count(F.lit(1))).first()[0]
    cell = F.substring("_key", 1, 4)  # at most 65,536 of them
    cells = docs.select(key.alias("_key")).groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("_key")
    ).withColumn("_cell", cell)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_key", "doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("_rank", rank).join(F.broadcast(cells), "_cell")
    placed = numbered.withColumn("_place", permuted(F.col("_before") + F.col("_rank") - 1, n_rows, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"),
        quotient(F.col("_place"), shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_feistel_shards(spark, sf_dir):
    return shard_rows(documents(configure(spark), sf_dir))
