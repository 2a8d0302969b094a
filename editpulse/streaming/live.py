"""Every window of a stream: the finished ones, empty or not, and the current one at each tick.

The state of the query holds one row per title and open pane (a slide-wide
stretch of time). A micro-batch writes the panes it changed to a folder of its
own, the one run of the stateful plan, and all else is made of written panes:

* the current window, which ends with the newest pane: its counts by title are
  those of the tick before, plus what panes gained, less the panes that left;
* the documents of all windows of the slide grid that the watermark has passed,
  with zeros where a window holds no edit.

A record per micro-batch names the folders that count (:class:`CommitLog`). A
retry starts from the record before its own, so it repeats nothing and loses
nothing, and readers never meet half a tick. Panes are merged now and then, and
what no record names any more is deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..config import DEFAULTS, Settings
from ..functions import to_iso
from ..operators import live, rates, trend
from ..schemas import WINDOW_SNAPSHOT
from ..sinks import CommitLog, append_metrics, write_batch
from .ingest import trigger

PANES = "pane long, title string, edits long, newest timestamp"
TOTALS = "title string, recent_edits long"
KEYS = ["window_start", "window_end"]

Baseline = DataFrame | Callable[[DataFrame], DataFrame] | None


def pane_stream(events: DataFrame, settings: Settings = DEFAULTS, ts: str = "timestamp") -> DataFrame:
    """Edits so far per title and pane, with the time of the newest record (for update mode).

    Records without a title count nowhere, but time goes on with them.
    """
    title = F.when(F.col("title") != "", F.col("title"))
    timed = events.select(F.col(ts).alias("ts"), title.alias("title")).withWatermark("ts", settings.watermark_delay)
    pane = F.window("ts", f"{settings.slide_seconds} seconds")
    counted = timed.groupBy(pane.alias("w"), "title").agg(F.count("title").alias("edits"), F.max("ts").alias("newest"))
    return counted.select(F.unix_seconds("w.start").alias("pane"), "title", "edits", "newest")


def with_clock(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add a record without a title every second, so that time passes in quiet spells too (arrival time only)."""
    clock = events.sparkSession.readStream.format("rate").option("rowsPerSecond", "1").load()
    beats = clock.select(F.col("timestamp").alias(ts), F.lit(None).cast("string").alias("title"))
    return events.select(ts, "title").unionByName(beats)


class LiveWindows:
    """The tick of the stream: from changed panes to published documents."""

    def __init__(
        self,
        output: str,
        baseline: Baseline = None,
        settings: Settings = DEFAULTS,
        policy: trend.TrendPolicy = trend.RATE,
        window: Callable[[], int] | None = None,
        longest: int | None = None,
        keep: int = 2,
        merge_after: int = 32,
    ):
        self.root, self.baseline, self.settings, self.policy = output.rstrip("/"), baseline, settings, policy
        self.window = window or (lambda: settings.window_seconds)
        self.longest, self.keep, self.merge_after = longest or settings.window_seconds, keep, merge_after

    # ------------------------------------------------------------ one tick

    def tick(self, batch: DataFrame, batch_id: int) -> None:
        spark, slide = batch.sparkSession, self.settings.slide_seconds
        log = CommitLog(spark, f"{self.root}/commits")
        last = log.latest(below=batch_id)
        was = last[1] if last else {"panes": [], "published": None, "newest": None}
        self._clean(log, batch_id, was)

        write_batch(batch, f"{self.root}/panes", batch_id)
        changed = spark.read.schema(PANES).parquet(f"{self.root}/panes/batch_id={batch_id}")
        seen = changed.agg(F.min("pane"), F.min(F.when(F.col("edits") > 0, F.col("pane"))), F.unix_micros(F.max("newest"))).first()
        touched, first_edit, newest = seen
        if newest is None and was["newest"] is None:
            return
        now = dict(was, batch=batch_id, window=self._window(), panes=list(was["panes"]), dropped=[])
        if touched is None:
            log.drop(f"{self.root}/panes/batch_id={batch_id}")
        else:
            now["panes"].append(f"panes/batch_id={batch_id}")
            now["newest"] = max(newest, was["newest"] or newest)
            known = [p for p in (first_edit, was.get("oldest")) if p is not None]
            now["oldest"] = min(known) if known else None
        now["end"] = (now["newest"] // 1_000_000 // slide + 1) * slide
        self._follow_window(spark, was, now, touched)
        self._publish_current(spark, now)
        self._publish_finished(spark, now, was["newest"])
        self._merge(spark, now)
        log.put(batch_id, now)

    def _window(self) -> int:
        seconds = int(self.window())
        if seconds % self.settings.slide_seconds or not 0 < seconds <= self.longest:
            raise ValueError(f"a window of {seconds} s is no multiple of the slide, or longer than {self.longest} s")
        return seconds

    def _panes(self, spark: SparkSession, record: dict, low: int, high: int) -> DataFrame:
        """Counts of the panes of a record in [low, high). A count only grows, so the largest is the newest."""
        if not record["panes"]:
            return spark.createDataFrame([], "pane long, title string, edits long")
        stored = spark.read.schema(PANES).parquet(*[f"{self.root}/{p}" for p in record["panes"]])
        inside = stored.where((F.col("pane") >= low) & (F.col("pane") < high) & (F.col("edits") > 0))
        return inside.groupBy("pane", "title").agg(F.max("edits").alias("edits"))

    def _follow_window(self, spark: SparkSession, was: dict, now: dict, touched: int | None) -> None:
        """Write the counts of the current window: the last ones, moved on, or all panes where that is less work."""
        start, end = now["end"] - now["window"], now["end"]
        same = was.get("window") == now["window"] and was.get("totals")
        if same and touched is None and was["end"] == end:
            return
        low = end if touched is None else touched
        if same and low > start and was["end"] > start:
            rows = self._gained(spark, was, now, low).unionByName(spark.read.schema(TOTALS).parquet(f"{self.root}/{was['totals']}"))
        else:
            rows = self._panes(spark, now, start, end).select("title", F.col("edits").alias("recent_edits"))
        totals = rows.groupBy("title").agg(F.sum("recent_edits").alias("recent_edits")).where("recent_edits != 0")
        write_batch(totals, f"{self.root}/totals", now["batch"])
        now["totals"] = f"totals/batch_id={now['batch']}"

    def _gained(self, spark: SparkSession, was: dict, now: dict, low: int) -> DataFrame:
        """What the current window gains by title: panes changed (from ``low`` on) less what they were, less panes that left."""
        start, pane, edits = now["end"] - now["window"], F.col("pane"), F.col("edits")
        rows = [(was["panes"], False), ([p for p in now["panes"] if p not in was["panes"]], True)]
        parts = [
            spark.read.schema(PANES).parquet(*[f"{self.root}/{p}" for p in folders]).withColumn("new", F.lit(new)) for folders, new in rows if folders
        ]
        left, changed = (pane >= was["end"] - was["window"]) & (pane < start), pane >= low
        both = reduce(DataFrame.unionByName, parts).where((left | changed) & (edits > 0)).groupBy("pane", "title").agg(
            F.max(F.when(~F.col("new"), edits)).alias("before"), F.max("edits").alias("after")
        )
        after = F.when(pane >= low, F.col("after")).otherwise(0)
        return both.select("title", (after - F.coalesce("before", F.lit(0))).alias("recent_edits"))

    # ------------------------------------------------------------ documents

    def _documents(self, counts: DataFrame, grid: DataFrame, window: int) -> DataFrame:
        """A document per window of the grid; counts hold (window_start, window_end, title, recent_edits)."""
        known = self.baseline
        if callable(known) and not isinstance(known, DataFrame):
            least = self.policy.least_edits(self.settings)
            known = known(counts.where(F.col("recent_edits") >= least).select("title").distinct())
        ranked = trend.trending(counts, known, window, self.policy, self.settings, per=KEYS)
        stamp = to_iso(F.current_timestamp())
        busy = live.snapshots(counts, ranked, window, stamp, KEYS)
        rows = busy.schema["trending_articles"].dataType
        return grid.join(busy.drop("generated_at", "window_seconds"), KEYS, "left").select(
            stamp.alias("generated_at"), *KEYS, F.lit(window).alias("window_seconds"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_events_in_window", "distinct_articles_in_window")],
            F.coalesce("trending_articles", F.array().cast(rows)).alias("trending_articles"),
        )

    def _grid(self, spark: SparkSession, first: int, last: int, window: int) -> DataFrame:
        ends = spark.range(first, last + 1, self.settings.slide_seconds)
        return ends.select(F.timestamp_seconds(F.col("id") - window).alias("window_start"), F.timestamp_seconds("id").alias("window_end"))

    def _store(self, documents: DataFrame, folder: str, batch_id: int) -> None:
        documents.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.root}/{folder}/batch_id={batch_id}")

    def _publish_current(self, spark: SparkSession, now: dict) -> None:
        start, end = (F.timestamp_seconds(F.lit(s)) for s in (now["end"] - now["window"], now["end"]))
        totals = spark.read.schema(TOTALS).parquet(f"{self.root}/{now['totals']}")
        counts = totals.select(start.alias("window_start"), end.alias("window_end"), "title", "recent_edits")
        documents = self._documents(counts, self._grid(spark, now["end"], now["end"], now["window"]), now["window"])
        self._store(documents.coalesce(1), "current", now["batch"])
        now["current"] = f"current/batch_id={now['batch']}"
        stored = spark.read.schema(WINDOW_SNAPSHOT).json(f"{self.root}/{now['current']}")
        append_metrics(rates.snapshot_metrics(stored, F.col("window_end"), self.settings.metric_namespace), f"{self.root}/metrics", now["batch"])

    def _publish_finished(self, spark: SparkSession, now: dict, newest_before: int | None) -> None:
        """All grid windows behind the watermark, from the last one published on; the first is the first that may hold an edit.

        Spark turns late records away by the watermark of the batch before, so
        what this batch moves it to is final with the next one (which comes by
        itself when the watermark moves).
        """
        if newest_before is None:
            return
        slide, window = self.settings.slide_seconds, now["window"]
        newest = F.timestamp_micros(F.lit(newest_before)) - F.expr(f"INTERVAL {self.settings.watermark_delay}")
        passed = spark.range(1).select(F.unix_seconds(newest)).first()[0]
        last = passed // slide * slide
        if now["published"] is not None:
            first = now["published"] + slide
        elif now["oldest"] is not None:
            first = now["oldest"] + slide
        else:
            return
        if first > last:
            return
        panes = self._panes(spark, now, first - window, last)
        ends = F.sequence(F.greatest(F.col("pane") + slide, F.lit(first)), F.least(F.col("pane") + window, F.lit(last)), F.lit(slide).cast("long"))
        copies = panes.select(F.explode(ends).alias("end"), "title", "edits")
        counts = copies.groupBy("end", "title").agg(F.sum("edits").alias("recent_edits")).select(
            F.timestamp_seconds(F.col("end") - window).alias("window_start"), F.timestamp_seconds("end").alias("window_end"), "title", "recent_edits",
        )
        self._store(self._documents(counts, self._grid(spark, first, last, window), window), "history", now["batch"])
        now["published"] = last

    # ------------------------------------------------------------ upkeep

    def _oldest_needed(self, now: dict) -> int:
        ends = [now["end"]] + ([now["published"] + self.settings.slide_seconds] if now["published"] is not None else [])
        low = min(ends) - self.longest
        return low if now["published"] is not None or now["oldest"] is None else min(low, now["oldest"])

    def _merge(self, spark: SparkSession, now: dict) -> None:
        """Write the panes still needed as one folder, once there are many."""
        if len(now["panes"]) <= self.merge_after:
            return
        live_panes = self._panes(spark, now, self._oldest_needed(now), now["end"])
        folder = f"merged/batch_id={now['batch']}"
        live_panes.select("pane", "title", "edits", F.lit(None).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{self.root}/{folder}")
        now["dropped"], now["panes"] = now["panes"], [folder]

    def _clean(self, log: CommitLog, batch_id: int, was: dict) -> None:
        """Delete what only records before the last one named. Its own predecessors are safe to go: this batch begins after it."""
        old = [n for n in log.numbers() if n < batch_id - 1]
        for number in old:
            record = log.get(number)
            named = [*record["dropped"], record["totals"]]
            log.drop(*[f"{self.root}/{f}" for f in named if f not in was["panes"] and f != was.get("totals")])
        for number in old:
            if number < batch_id - self.keep:
                log.drop(f"{self.root}/current/batch_id={number}")
        log.forget(batch_id - max(self.keep, 1))


def live_stream(
    events: DataFrame,
    output: str,
    checkpoint: str,
    baseline: Baseline = None,
    settings: Settings = DEFAULTS,
    policy: trend.TrendPolicy = trend.RATE,
    seconds: float | None = DEFAULTS.trigger_seconds,
    window: Callable[[], int] | None = None,
    longest: int | None = None,
    keep: int = 2,
) -> StreamingQuery:
    """Publish the current window at every tick and each finished window once, empty ones too.

    Below ``output``: ``history`` (finished windows), ``current`` (the last ``keep``
    ticks), ``metrics``, and the tables of the stream itself. ``baseline`` may be a
    function of the titles asked for (see ``StoredBaseline``). ``window`` is asked
    for the length of the window at every tick, up to ``longest`` seconds; windows
    published before a change keep the length they had.
    """
    windows = LiveWindows(output, baseline, settings, policy, window, longest, keep)
    writer = pane_stream(events, settings).writeStream.outputMode("update").foreachBatch(windows.tick)
    return trigger(writer.option("checkpointLocation", checkpoint), seconds).start()


def read_current(spark: SparkSession, output: str) -> DataFrame:
    """The document of the last tick; no row before the first."""
    last = CommitLog(spark, f"{output.rstrip('/')}/commits").latest()
    if last is None:
        return spark.createDataFrame([], WINDOW_SNAPSHOT)
    return spark.read.schema(WINDOW_SNAPSHOT).json(f"{output.rstrip('/')}/{last[1]['current']}")


def read_ticks(spark: SparkSession, output: str) -> DataFrame:
    """The documents of all ticks that are kept, with their ``batch_id``."""
    schema = StructType([*WINDOW_SNAPSHOT.fields, StructField("batch_id", LongType())])
    return spark.read.schema(schema).json(f"{output.rstrip('/')}/current")
