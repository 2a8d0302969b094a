"""Mixing sources to target weights by systematic sampling (operator 8).

A source's documents stand in a fixed order; each adds its expected copies to a
running sum; one random offset is added, and a document is taken once for each
integer that its step crosses. So every count is off by less than one copy, and
all sums are functions of a document's rank: reruns agree.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window, functions as F

from editpulse.llm.common import WORD, Scratch, documents, whole

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Many documents agree in a size below this, so cells of such sizes are finer.
SHORT = 64


def offset_of(seed: int) -> float:
    return random.Random(seed).random()


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> with target: the share by weight, none above ``most`` times its size.

    Sources fill in the order in which they reach their cap when one level rises
    for all in proportion to weight. Those before the first that stays below its
    cap are full; the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    known = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    # Caps are whole numbers, so their sums don't depend on the order.
    full = F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    levels = known.withColumn("_level", (total - full) / open_w).withColumn("_nth", F.row_number().over(by_level))
    below = F.col("_level") * F.col("_w") < F.col("_cap")
    every = Window.orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min_by(F.when(below, F.col("_level")), F.when(below, F.col("_nth"))).over(every)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, with_rows: bool = False, seed: int = 8) -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies; and ``row``, a struct of all columns, if asked for.

    Order within a source: words to six leading bits, a digit of the md5 of
    doc_id, words, md5, doc_id. Neighbours are alike in size, so what copies
    add up to comes near the target in words too. Null text has no words, null
    sources are one source, sources without words take nothing. Rows that agree
    in all these share their copies in any order. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_count(whole(), F.lit(WORD)).cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_rows else []
    rows = scratch.table(docs.select("doc_id", "source", *row, words.alias("size"), key.alias("_key")), "rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = scratch.table(targets(totals), "targets")

    bits = F.length(F.bin("size"))
    leading = F.call_function("shiftright", F.col("size"), F.greatest(bits - 6, F.lit(0)).cast("int"))
    cell = [F.lpad((bits * 64 + leading).cast("string"), 5, "0"), F.substring("_key", 1, 1)]
    # What comes next in the order: the size, then the digits that follow.
    cell += [F.lpad(F.col("size").cast("string"), 19, "0"), F.when(F.col("size") < SHORT, F.substring("_key", 2, 2)).otherwise(F.lit(""))]
    rows = rows.withColumn("_cell", F.concat(*cell))
    # Ranks in two levels: what cells before hold, then the rank within the cell; no task sorts a whole source.
    cells = rows.groupBy("source", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("source").alias("_source"), F.col("_cell").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_cell").orderBy("size", "_key", "doc_id")))
    ranked = ranked.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_cell") == F.col("_of")))
    goals = goals.withColumnRenamed("source", "_goal")
    joined = ranked.join(goals, F.col("source").eqNullSafe(F.col("_goal")))

    rank, start = F.col("_before") + F.col("_rank"), F.lit(offset_of(seed))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rank * expected + start) - F.floor((rank - 1) * expected + start)
    return joined.select("doc_id", "source", *(["row"] if with_rows else []), "size", "source_size", "target", crossed.cast("long").alias("copies"))


def op8_mix_sources(spark, sf_dir):
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
