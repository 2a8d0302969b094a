"""Numbered records that say which written folders count.

A job writes its tables to new folders first and then a record that names them.
A record is written beside its place and renamed into it, so a reader meets the
old state or the new one and never half of it.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitLog:
    """JSON records by number in a folder of any file system Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def numbers(self) -> list[int]:
        folder = self._path(self.folder)
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[0].isdigit())

    def get(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self, below: int | None = None) -> tuple[int, dict] | None:
        """The newest record, or the newest with a smaller number."""
        numbers = [n for n in self.numbers() if below is None or n < below]
        return (numbers[-1], self.get(numbers[-1])) if numbers else None

    def put(self, number: int, record: dict) -> None:
        """Write a record; the same number again replaces it."""
        beside, place = self._path(f"{self.folder}/_{number}.tmp"), self._path(f"{self.folder}/{number}.json")
        out = self.fs.create(beside, True)
        out.write(bytearray(json.dumps(record), "utf-8"))
        out.close()
        if self.fs.exists(place):
            self.fs.delete(place, False)
        if not self.fs.rename(beside, place):
            raise OSError(f"cannot commit {place}")

    def forget(self, below: int) -> None:
        for number in self.numbers():
            if number < below:
                self.fs.delete(self._path(f"{self.folder}/{number}.json"), False)

    def drop(self, *folders: str) -> None:
        """Delete folders that no record names any more."""
        for folder in folders:
            self.fs.delete(self._path(folder), True)
