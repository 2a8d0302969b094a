"""The batch layer kept up to date: each run reads the input files that are new.

Kept between runs, each in folders of the run that wrote it:

* ``inputs``: the files merged so far;
* ``rollup``: edits per (title, hour, bot, namespace), by date. A run replaces the
  dates it touches and leaves the others alone;
* ``slots``: edits per (hour, bot, namespace), by date, from which the small tables
  are made;
* ``titles``: edits and active hours per title, moved on by what the touched dates
  gained;
* ``editors``: the users seen for the first time in that run.

A record per run names the folders that count; it is the last thing written. A run
that dies leaves the state of the run before, and its folders are written again by
the next one. Readers of the run before can go on: its folders go one run later.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULTS, Settings
from ..operators import history
from ..sinks import CommitLog

INPUTS = "path string, length long"
ROLLUP = "title string, edit_hour timestamp, bot boolean, namespace int, edits long"
SLOTS = "edit_hour timestamp, bot boolean, namespace int, edits long"
TITLES = "title string, edits long, hours long"
#: The name of the date of edits without a time.
NO_DATE = "none"


class BatchState:
    """The tables of the last run, and where the next one writes."""

    def __init__(self, spark: SparkSession, output: str):
        self.spark, self.root = spark, output.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/commits")
        last = self.log.latest()
        self.run = last[0] + 1 if last else 0
        self.record = last[1] if last else {"inputs": [], "editors": [], "rollup": {}, "slots": {}, "titles": [], "superseded": []}

    def read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def write(self, frame: DataFrame, name: str, *by: str) -> str:
        writer = frame.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{name}/run={self.run}")
        return f"{name}/run={self.run}"

    def dated(self, name: str, dates: list[str], schema: str) -> DataFrame:
        return self.read([self.record[name][d] for d in dates if d in self.record[name]], schema)


def input_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Path and length of every file below a folder, listed by Spark and not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return listed.load(path).select("path", "length")


def _date(hour: Column) -> Column:
    return F.coalesce(F.date_format(hour, "yyyy-MM-dd"), F.lit(NO_DATE))


def _per_title(rollup: DataFrame) -> DataFrame:
    """Edits and hours with edits per title; an hour lies in one date, so both add up over dates."""
    return history.article_hours(rollup).groupBy("title").agg(F.sum("hourly_edits").alias("edits"), F.count(F.lit(1)).alias("hours"))


def update_batch_layer(
    spark: SparkSession,
    source: str,
    output: str,
    reader: Callable[[list[str]], DataFrame] | None = None,
    settings: Settings = DEFAULTS,
    pattern: str = "*.parquet",
) -> dict[str, str]:
    """Merge the files below ``source`` that no run has merged, and write the six tables anew; returns their paths.

    ``reader`` makes events of a list of files (Parquet event tables by default).
    Files only come and never change; one whose length is another now is an error.
    Without new files nothing is written.
    """
    state = BatchState(spark, output)
    was, now = state.record, dict(state.record)
    files, merged = input_files(spark, source, pattern), state.read(was["inputs"], INPUTS)
    changed = files.join(merged.withColumnRenamed("length", "before"), "path").where("length != before").select("path").first()
    if changed:
        raise ValueError(f"{changed.path} has changed since it was merged")
    new = files.join(merged, "path", "left_anti")
    now["inputs"] = was["inputs"] + [state.write(new, "inputs")]
    # Names of new files only; the first run of a long history names them all.
    paths = [r.path for r in state.read(now["inputs"][-1:], INPUTS).select("path").collect()]
    if not paths:
        state.log.drop(f"{state.root}/{now['inputs'][-1]}")
        return table_paths(spark, output)

    events = reader(paths) if reader else spark.read.parquet(*paths)
    events = events.select("title", "user", "bot", "namespace", F.col("timestamp").cast("timestamp").alias("timestamp"))
    fresh = state.write(history.hour_rollup(events).withColumn("event_date", _date(F.col("edit_hour"))), "fresh", "event_date")
    gained = spark.read.schema(f"{ROLLUP}, event_date string").parquet(f"{state.root}/{fresh}")
    dates = sorted(r[0] for r in gained.select("event_date").distinct().collect())
    before = state.dated("rollup", dates, ROLLUP)
    keys = ["title", "edit_hour", "bot", "namespace"]
    after = before.unionByName(gained.drop("event_date")).groupBy(*keys).agg(F.sum("edits").alias("edits"))
    folder = state.write(after.withColumn("event_date", _date(F.col("edit_hour"))), "rollup", "event_date")
    now["rollup"] = was["rollup"] | {d: f"{folder}/event_date={d}" for d in dates}
    touched = state.read([now["rollup"][d] for d in dates], ROLLUP)

    slots = touched.groupBy(*keys[1:]).agg(F.sum("edits").alias("edits"))
    folder = state.write(slots.withColumn("event_date", _date(F.col("edit_hour"))).coalesce(1), "slots", "event_date")
    now["slots"] = was["slots"] | {d: f"{folder}/event_date={d}" for d in dates}

    parts = [state.read(was["titles"], TITLES), _per_title(touched), _per_title(before).selectExpr("title", "-edits as edits", "-hours as hours")]
    titles = reduce(DataFrame.unionByName, parts).groupBy("title").agg(F.sum("edits").alias("edits"), F.sum("hours").alias("hours"))
    now["titles"] = [state.write(titles, "titles")]

    known = state.read(was["editors"], "user string")
    users = events.where("user is not null").select("user").distinct().join(known, "user", "left_anti")
    now["editors"] = was["editors"] + [state.write(users, "editors")]

    state.record = now
    tables = six_tables(state, settings)
    # The baseline has a row per article; the others are small by construction.
    small = {n: t if n == "article_baseline" else t.coalesce(1) for n, t in tables.items()}
    now["tables"] = {name: state.write(table, f"tables/{name}") for name, table in small.items()}
    old = [was["rollup"][d] for d in dates if d in was["rollup"]] + [was["slots"][d] for d in dates if d in was["slots"]]
    now["superseded"] = old + was["titles"] + list(was.get("tables", {}).values())
    now["files"] = len(paths)
    state.log.put(state.run, now)
    state.log.drop(f"{state.root}/{fresh}", *[f"{state.root}/{f}" for f in was["superseded"]])
    state.log.forget(state.run - 1)
    return table_paths(spark, output)


def six_tables(state: BatchState, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """The tables of the batch layer from what is kept."""
    slots = state.read(sorted(state.record["slots"].values()), SLOTS)
    titles = state.read(state.record["titles"], TITLES)
    editors = state.read(state.record["editors"], "user string")
    by_title = titles.select("title", F.col("edits").alias("edit_count"))
    totals = titles.agg(F.coalesce(F.sum("edits"), F.lit(0)).alias("total_stored_events"), F.count("title").alias("total_articles"))
    return {
        "top_articles": by_title.orderBy(F.desc("edit_count"), "title").limit(settings.batch_top_n),
        "bot_vs_human": history.bot_counts(slots),
        "namespace_breakdown": history.namespace_counts(slots),
        "edit_rate_hourly": history.hourly_counts(slots),
        "article_baseline": titles.select("title", (F.col("edits").cast("double") / F.col("hours")).alias("baseline_edits_per_hour")),
        "summary": totals.select("*", editors.agg(F.count("user").alias("total_editors")).scalar().alias("total_editors")),
    }


def table_paths(spark: SparkSession, output: str) -> dict[str, str]:
    """Where the tables of the last run are."""
    last = CommitLog(spark, f"{output.rstrip('/')}/commits").latest()
    return {name: f"{output.rstrip('/')}/{folder}" for name, folder in last[1]["tables"].items()} if last else {}
