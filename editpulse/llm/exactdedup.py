"""Exact dedup through an extendible-hash index on shared files (operator 6).

The key is a 64-bit hash of the text without white space. The directory is grown
by doubling from the counts of the 65,536 leading key prefixes: an overfull
bucket is split by its next bit, and the directory doubles when the bucket is as
deep as it is. A bucket that no bit can split (copies of one text) gets pages.
Each bucket or page has one owner task, which reads its rows by key, compares the
bytes of rows with equal keys, chains different texts of one key, and writes its
part of the index: key, digest of the text in the chain, row. Pages of one bucket
meet again by key and digest, where counts are added in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from editpulse.llm.common import SPACES, Scratch, documents, partitions, whole

DEPTH = 16
CAPACITY, MOST_BUCKETS = 512, 1 << 15
INDEX = "bucket long, page long, key long, digest string, doc_id long, row long, n_chars long"


def grow_directory(counts: dict[int, int], capacity: int, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """Per prefix of ``depth`` bits: (prefix, bucket, pages), after all splits that help.

    A bucket is (local depth, its leading bits). The directory has an entry for
    each value of as many bits as the deepest bucket has.
    """
    at_depth = [dict(counts)]
    for _ in range(depth):
        above: dict[int, int] = {}
        for prefix, n in at_depth[-1].items():
            above[prefix >> 1] = above.get(prefix >> 1, 0) + n
        at_depth.append(above)
    at_depth.reverse()  # at_depth[d]: rows by the leading d bits
    global_depth, directory = 0, [(0, 0)]
    overfull = [(0, 0)]
    while overfull:
        local, bits = overfull.pop()
        if at_depth[local].get(bits, 0) <= capacity or local == depth:
            continue
        if local == global_depth:
            directory = [bucket for bucket in directory for _ in range(2)]
            global_depth += 1
        halves = [(local + 1, bits << 1), (local + 1, bits << 1 | 1)]
        for half in halves:
            width = 1 << (global_depth - half[0])
            directory[half[1] * width : (half[1] + 1) * width] = [half] * width
        overfull.extend(halves)
    rows = []
    for prefix in range(1 << depth):
        local, bits = directory[prefix >> (depth - global_depth)]
        n = at_depth[local].get(bits, 0)
        rows.append((prefix, (1 << local) | bits, -(-n // capacity) if local == depth and n > capacity else 1))
    return rows


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, page and key -> index rows; a chain holds the texts of one key only."""
    place, chain = None, {}
    names = ["bucket", "page", "key", "digest", "doc_id", "row", "n_chars"]
    for batch in batches:
        digests = []
        keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "page", "key")))
        for now, text in zip(keys, batch.column("norm").to_pylist()):
            if now != place:
                place, chain = now, {}
            digest = next((d for other, d in chain.items() if other == text), None)
            if digest is None:
                digest = chain[text] = hashlib.sha256(text).hexdigest()
            digests.append(digest)
        columns = [batch.column(c) if c != "digest" else pa.array(digests, pa.string()) for c in names]
        yield pa.RecordBatch.from_arrays(columns, names)


def build_index(docs: DataFrame, scratch: Scratch, capacity: int | None = None) -> DataFrame:
    """The index table: one row per row of ``docs``, written by the owners of the buckets."""
    spark = docs.sparkSession
    norm = F.translate(whole(), SPACES, "")
    prefix = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - DEPTH)).cast("int")
    hashed = docs.select(F.xxhash64(norm).alias("key"))
    counts = {r["prefix"]: r["n"] for r in hashed.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    capacity = capacity or max(CAPACITY, -(-rows // MOST_BUCKETS))
    directory = spark.createDataFrame(grow_directory(counts, capacity), "prefix int, bucket long, pages long")
    directory = scratch.table(directory.coalesce(1), "directory")
    keyed = docs.select(
        "doc_id", F.length(whole()).cast("long").alias("n_chars"), norm.alias("norm"), F.monotonically_increasing_id().alias("row")
    ).withColumn("key", F.xxhash64("norm")).withColumn("prefix", prefix)
    # 65,536 rows at any size of the input.
    placed = keyed.join(F.broadcast(directory), "prefix")
    page = F.when(F.col("pages") > 1, F.pmod(F.xxhash64("row"), F.col("pages"))).otherwise(F.lit(0).cast("long"))
    dealt = placed.select("bucket", page.alias("page"), "key", F.col("norm").cast("binary").alias("norm"), "doc_id", "row", "n_chars")
    dealt = dealt.repartition(partitions(spark), "bucket", "page").sortWithinPartitions("bucket", "page", "key")
    return scratch.table(dealt.mapInArrow(own, INDEX), "index")


def exact_duplicates(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Null text counts as empty, and texts of white space only equal it. Of equal
    texts the row with the most code points stays, then that with the smallest
    doc_id (null last), then the first row. Repeated rows are rows: one stays.
    Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    index = build_index(docs, scratch, capacity)
    # ~x turns the order of longs round without overflow.
    small = F.coalesce(F.bitwise_not("doc_id"), F.lit(-(2**63)))
    rank = F.struct("n_chars", small.alias("small"), (-F.col("row")).alias("early"))
    best = index.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max_by(F.struct("doc_id", "row"), rank).alias("best")
    )
    best = scratch.table(best, "groups")
    joined = index.join(best, ["key", "digest"])
    return joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))
