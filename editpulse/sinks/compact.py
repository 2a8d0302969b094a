"""Few large files for the closed dates of an event store that is flushed every few seconds.

A run reads the files of closed dates that no run has merged, with what the dates
hold already, and writes the dates anew below ``_compacted`` of the store. A record
names the folder of each date and the files merged into it; it is put in place
last, so a reader of :func:`read_store` sees a date as it was or as it is, also when
a run dies halfway. Edits that come late into a closed date are read from their
small files until the next run. The store's own files are left as they are: the log
of the stream that writes them names them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .commits import CommitLog

FILES = "path string"
_DATE = re.compile(r"/event_date=([^/]+)/")


class CompactedStore:
    """What is merged of a store, and what is not."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self.root = f"{self.store}/_compacted"
        self.log = CommitLog(spark, f"{self.root}/commits")
        last = self.log.latest()
        self.run = last[0] + 1 if last else 0
        self.record = last[1] if last else {"dates": {}, "merged": [], "superseded": []}

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(self.store)

    def open_files(self) -> list[str]:
        """Names of the store's files that no run has merged; a stream's log decides which files count."""
        files = self.stored().inputFiles()
        if not self.record["merged"]:
            return files
        merged = self.spark.read.schema(FILES).parquet(*[f"{self.root}/{m}" for m in self.record["merged"]])
        known = {r.path for r in merged.toLocalIterator()}
        return [f for f in files if f not in known]

    def files(self, paths: list[str], base: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def read(self, paths: list[str], dates: list[str]) -> DataFrame:
        """The rows of some of the store's files and of some merged dates."""
        schema = self.stored().schema
        parts = [self.files(paths, self.store, schema)] if paths else []
        folders = [f"{self.root}/{self.record['dates'][d]}" for d in dates if d in self.record["dates"]]
        if folders:
            parts.append(self.files(folders, self.root, schema).select(*schema.fieldNames()))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact_store(spark: SparkSession, store: str, before: str, ts: str = "timestamp") -> list[str]:
    """Merge the files of all dates before a date (yyyy-MM-dd); returns the dates written anew.

    Tasks hold ranges of (date, time), so a busy date has as many files as its rows need.
    """
    state = CompactedStore(spark, store)
    dated = [(m[1], f) for f in state.open_files() if (m := _DATE.search(f)) and m[1] < before]
    if not dated:
        return []
    dates, folder = sorted({d for d, _ in dated}), f"run={state.run}"
    rows = state.read([f for _, f in dated], dates)
    placed = rows.repartitionByRange("event_date", ts).sortWithinPartitions("event_date", ts)
    placed.write.mode("overwrite").partitionBy("event_date").parquet(f"{state.root}/{folder}")
    names = spark.createDataFrame([(f,) for _, f in dated], FILES)
    names.coalesce(1).write.mode("overwrite").parquet(f"{state.root}/files/{folder}")
    was = state.record
    state.log.put(state.run, {
        "dates": was["dates"] | {d: f"{folder}/event_date={d}" for d in dates},
        "merged": was["merged"] + [f"files/{folder}"],
        "superseded": [was["dates"][d] for d in dates if d in was["dates"]],
    })
    # Readers of the record before may still be at work; what it had replaced is free to go.
    state.log.drop(*[f"{state.root}/{f}" for f in was["superseded"]])
    state.log.forget(state.run - 1)
    return dates


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The whole event store: merged dates from their large files, all else from the small ones."""
    state = CompactedStore(spark, store)
    return state.read(state.open_files(), sorted(state.record["dates"]))
