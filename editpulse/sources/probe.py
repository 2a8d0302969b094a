"""A baseline table of which only the titles asked for are read.

The table is written in buckets of titles, sorted, with a Bloom filter on the
title in each file. A micro-batch names its candidates; their buckets are the
partitions that are read, and a short list of titles reaches the Parquet reader
too, where the Bloom filters skip the rest. A version is a folder of its own, put
in place by a commit, so streams may probe while a batch job writes the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import BASELINE
from ..sinks.commits import CommitLog

#: Rows of a bucket, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 8192, 8192
#: As many equalities as Parquet's reader is given for a list of values by default.
SHORT_LIST = 10


def _bucket(title: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(title), F.lit(buckets)).cast("int")


def store_baseline(baseline: DataFrame, path: str, rows_per_bucket: int = BUCKET_ROWS) -> None:
    """Write the next version below ``path``; the one before stays for those who still read it."""
    spark, root = baseline.sparkSession, path.rstrip("/")
    log = CommitLog(spark, f"{root}/commits")
    last = log.latest()
    number = last[0] + 1 if last else 0
    usable = baseline.select("title", F.col("baseline_edits_per_hour").cast("double").alias("baseline_edits_per_hour")).dropna()
    usable = usable.where("baseline_edits_per_hour > 0")
    buckets = min(max(-(-usable.count() // rows_per_bucket), 1), MOST_BUCKETS)
    dealt = usable.withColumn("bucket", _bucket("title", buckets)).repartition("bucket").sortWithinPartitions("bucket", "title")
    writer = dealt.write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#title", "true")
    writer.parquet(f"{root}/version={number}")
    log.put(number, {"folder": f"version={number}", "buckets": buckets})
    for old in log.numbers():
        if old < number - 1:
            log.drop(f"{root}/version={old}")
    log.forget(number - 1)


class StoredBaseline:
    """A function of titles: the rows of a stored baseline that may match them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")

    def __call__(self, titles: DataFrame) -> DataFrame:
        """The newest version's rows in the buckets of ``titles`` (title); none where nothing is stored yet."""
        last = CommitLog(self.spark, f"{self.root}/commits").latest()
        if last is None:
            return self.spark.createDataFrame([], BASELINE)
        buckets = last[1]["buckets"]
        # As many numbers as the table has buckets, however many titles are asked for.
        wanted = [r[0] for r in titles.select(_bucket("title", buckets)).distinct().collect()]
        table = self.spark.read.schema("title string, baseline_edits_per_hour double, bucket int")
        rows = table.parquet(f"{self.root}/{last[1]['folder']}").where(F.col("bucket").isin(wanted))
        if len(wanted) <= SHORT_LIST:
            few = [r[0] for r in titles.select("title").distinct().limit(SHORT_LIST + 1).collect()]
            if len(few) <= SHORT_LIST:
                rows = rows.where(F.col("title").isin(few))
        return rows.drop("bucket")
