"""Trailing and sliding windows over event time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULTS


# The column the event store is partitioned by.
DATE_PARTITION = "event_date"


def seconds_interval(seconds: int) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds))


def window_start(events: DataFrame, seconds: int, anchor: Column | datetime | None, ts: str) -> Column:
    """Where the trailing window begins.

    Without an anchor this is a scalar subquery over one column. The subtraction
    is done inside it: a bare subquery value is pushed down to the Parquet scan.
    """
    length = seconds_interval(seconds)
    if anchor is None:
        return events.agg(F.max(ts) - length).scalar()
    return (anchor if isinstance(anchor, Column) else F.lit(anchor)) - length


def trailing(
    events: DataFrame,
    seconds: int = DEFAULTS.window_seconds,
    anchor: Column | datetime | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """Whole events with ``anchor - seconds <= ts <= anchor``; the anchor defaults to the newest event.

    On the stored table the dates before the window are not read at all. Give an
    anchor there, or finding the newest event reads the whole time column.
    """
    start = window_start(events, seconds, anchor, ts)
    kept = events.where(F.col(ts) >= start)
    if DATE_PARTITION in events.columns:
        kept = kept.where(F.col(DATE_PARTITION) >= F.to_date(start))
    if anchor is None:
        return kept
    return kept.where(F.col(ts) <= (anchor if isinstance(anchor, Column) else F.lit(anchor)))


def before_trailing(
    events: DataFrame,
    seconds: int = DEFAULTS.window_seconds,
    anchor: Column | datetime | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """The history a trailing window leaves out: ``ts < anchor - seconds``."""
    start = window_start(events, seconds, anchor, ts)
    kept = events.where(F.col(ts) < start)
    return kept.where(F.col(DATE_PARTITION) <= F.to_date(start)) if DATE_PARTITION in events.columns else kept


def title_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("title").agg(F.count("*").alias("recent_edits"))


def panes(events: DataFrame, slide_seconds: int = DEFAULTS.slide_seconds, ts: str = "timestamp") -> DataFrame:
    """Edits per title and slide-wide tumbling window, the building block of sliding windows."""
    pane = F.window(ts, f"{slide_seconds} seconds")
    return events.groupBy(pane.alias("pane"), "title").agg(F.count("*").alias("edits"))


def _busy_panes(counted: DataFrame, window_seconds: int, at_least: int) -> DataFrame:
    """Panes that may lie in a window with ``at_least`` edits.

    A window touches at most two neighbouring blocks of its own length, so it
    needs a pair of blocks that holds enough edits together. Most titles are
    edited too rarely to have one.
    """
    width = window_seconds * 1_000_000
    begin = F.unix_micros(F.col("pane.start").cast("timestamp"))
    placed = counted.withColumn("block", ((begin - F.pmod(begin, F.lit(width))) / F.lit(width)).cast("long"))
    busy = (
        placed.select("title", F.explode(F.array(F.col("block") - 1, F.col("block"))).alias("pair"), "edits")
        .groupBy("title", "pair")
        .agg(F.sum("edits").alias("n"))
        .where(F.col("n") >= at_least)
        .select(F.col("title").alias("_title"), F.explode(F.array(F.col("pair"), F.col("pair") + 1)).alias("_block"))
        .distinct()
    )
    # An inner join, since a semi join would be moved below the counting, to single events.
    same = F.col("title").eqNullSafe(F.col("_title")) & (F.col("block") == F.col("_block"))
    return placed.join(busy, same).drop("block", "_title", "_block")


def sliding_counts(
    events: DataFrame,
    window_seconds: int = DEFAULTS.window_seconds,
    slide_seconds: int = DEFAULTS.slide_seconds,
    ts: str = "timestamp",
    at_least: int = 1,
) -> DataFrame:
    """Edits per title and sliding window ``[window_start, window_end)``.

    Events are counted into panes first, so the copying of a row into each of
    its ``window / slide`` windows happens to pane counts and not to events.
    With ``at_least`` only windows with that many edits are returned, and panes
    that no such window can contain are not copied at all.
    """
    if window_seconds % slide_seconds:
        raise ValueError("the window must be a multiple of the slide")
    counted = panes(events, slide_seconds, ts)
    if at_least > 1:
        counted = _busy_panes(counted, window_seconds, at_least)
    windows = F.window(F.col("pane.start"), f"{window_seconds} seconds", f"{slide_seconds} seconds")
    return (
        counted.select(windows.alias("w"), "title", "edits")
        .groupBy("w", "title")
        .agg(F.sum("edits").alias("recent_edits"))
        .where(F.col("recent_edits") >= at_least)
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "title",
            "recent_edits",
        )
    )


#: Sketches of 2 ** DISTINCT_BITS registers: three standard errors (0.83 / sqrt(registers) each) are below 2 %.
DISTINCT_BITS, DISTINCT_ERROR = 14, 0.02


def pane_sketches(events: DataFrame, columns: Sequence[str], slide_seconds: int, ts: str = "timestamp") -> DataFrame:
    """Edits per slide-wide pane and, for each column, a sketch of its distinct values."""
    pane = F.window(ts, f"{slide_seconds} seconds")
    sketches = [F.hll_sketch_agg(c, F.lit(DISTINCT_BITS)).alias(f"_{c}") for c in columns]
    return events.groupBy(pane.alias("pane")).agg(F.count("*").alias("edits"), *sketches)


def united_sketches(panes: DataFrame, columns: Sequence[str], window: Column) -> DataFrame:
    """Edits and estimated distinct values (``near_<column>``) per window, from the sketches of its panes.

    Sketches merge without loss, so a window costs one small sketch per pane,
    however many edits the panes hold.
    """
    united = [F.hll_sketch_estimate(F.hll_union_agg(f"_{c}")).alias(f"near_{c}") for c in columns]
    return panes.groupBy(window.alias("w")).agg(F.sum("edits").alias("edits"), *united).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "edits", *[f"near_{c}" for c in columns]
    )


def sliding_distincts(
    events: DataFrame, columns: Sequence[str], window_seconds: int, slide_seconds: int, ts: str = "timestamp"
) -> DataFrame:
    """Edits and exact distinct values (``distinct_<column>``) per sliding window.

    Values are made distinct per pane before they are copied into windows, and
    each column has a pass of its own.
    """
    windows = F.window(F.col("pane.start"), f"{window_seconds} seconds", f"{slide_seconds} seconds").alias("w")
    pane = F.window(ts, f"{slide_seconds} seconds").alias("pane")
    result = events.groupBy(pane).agg(F.count("*").alias("edits")).select(windows, "edits").groupBy("w").agg(F.sum("edits").alias("edits"))
    for c in columns:
        values = events.where(F.col(c).isNotNull()).select(pane, c).distinct().select(windows, c).distinct()
        result = result.join(values.groupBy("w").agg(F.count(c).alias(f"distinct_{c}")), "w", "left")
    counts = [F.coalesce(f"distinct_{c}", F.lit(0)).alias(f"distinct_{c}") for c in columns]
    return result.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "edits", *counts)


#: Cells of a stretch of running sums.
STRETCH = 4096


def _sums_before(cells: DataFrame, keys: list[str], length: int) -> DataFrame:
    """For each (key, cell): ``whole``, the edits of the ``length`` cells before it."""
    zero, up, n = F.lit(0).cast("long"), F.col("cell") + 1, F.col("cell_edits")
    three = [(F.col("cell"), zero, True), (up, n, False), (up + length, -n, False)]
    each = F.explode(F.array(*[F.struct(c.alias("cell"), s.alias("step"), F.lit(q).alias("asked")) for c, s, q in three]))
    steps = cells.select(*keys, each.alias("s")).select(*keys, "s.*")
    # Dealt by stretch at once, which serves all that follows up to the bases.
    steps = steps.withColumn("stretch", F.floor(F.col("cell") / F.lit(STRETCH))).repartition(*keys, "stretch")
    # One row per cell: a cell that is asked for may also be where others go up or down.
    steps = steps.groupBy(*keys, "stretch", "cell").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    inner = Window.partitionBy(*keys, "stretch").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy(*keys, "stretch").agg(F.sum("step").alias("_total"))
    based = totals.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("stretch").alias("_stretch"), F.coalesce(F.sum("_total").over(before), zero).alias("_base")
    )
    same = F.col("stretch") == F.col("_stretch")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    summed = steps.withColumn("_inner", F.sum("step").over(inner)).where("asked")
    whole = summed.join(based, same).select(*keys, "cell", (F.col("_base") + F.col("_inner")).alias("whole"))
    return whole.where("whole != 0")


def trailing_counts(
    events: DataFrame,
    seconds: int = DEFAULTS.window_seconds,
    by: Sequence[str] = ("title",),
    ts: str = "timestamp",
) -> DataFrame:
    """The size of the trailing window at every event instant.

    One row per key and distinct timestamp: ``edits`` at that instant and
    ``trailing_edits`` in ``[ts - seconds, ts]``. With ``by=()`` the window is
    over all events.

    A key is never handled as one group. Time is cut into cells of a second, and

        trailing = whole cells inside the window
                 + the current cell up to this instant
                 - the oldest cell before this offset

    so a task sees one key in one cell, which has at most as many instants as a
    second has microseconds. The sum of whole cells goes up one cell after a cell
    and down again a window later; it is a running sum in stretches of STRETCH
    cells, on top of one over the stretches of a key. None of these grows with the
    traffic or the length of the window.
    """
    width = 1_000_000
    cells_per_window = seconds
    keys = list(by)

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    offset = F.pmod(micros, F.lit(width))
    instants = (
        events.where(F.col(ts).isNotNull())
        .groupBy(*keys, ts)
        .agg(F.count("*").alias("edits"))
        .select(*keys, ts, "edits", ((micros - offset) / F.lit(width)).cast("long").alias("cell"), offset.alias("offset"))
    )
    whole_cells = _sums_before(instants.groupBy(*keys, "cell").agg(F.sum("edits").alias("cell_edits")), keys, cells_per_window)

    # One list of additions and removals per (key, cell), in order of the offset:
    # the whole cells first, then each instant; an instant is removed again one
    # window later, for the instants after its own offset.
    zero = F.lit(0).cast("long")
    own = F.struct("cell", "edits", F.col("edits").alias("plus"), zero.alias("minus"))
    gone = F.struct((F.col("cell") + cells_per_window).alias("cell"), zero.alias("edits"), zero.alias("plus"), F.col("edits").alias("minus"))
    steps = instants.select(*keys, ts, "offset", F.explode(F.array(own, gone)).alias("s")).select(*keys, ts, "offset", "s.*").unionByName(
        whole_cells.select(
            *keys, F.lit(None).cast(events.schema[ts].dataType).alias(ts), "cell",
            F.lit(-1).cast("long").alias("offset"), zero.alias("edits"), F.col("whole").alias("plus"), zero.alias("minus"),
        )
    )
    in_cell = Window.partitionBy(*keys, "cell").orderBy("offset")
    added = F.sum("plus").over(in_cell.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    removed = F.sum("minus").over(in_cell.rangeBetween(Window.unboundedPreceding, -1))
    return (
        steps.withColumn("trailing_edits", added - F.coalesce(removed, F.lit(0)))
        .where("edits > 0")
        .select(*keys, ts, "edits", "trailing_edits")
    )
