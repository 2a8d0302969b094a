"""The raw landing zone: text objects that hold JSON values back to back.

Values may stand side by side without any separator, which no line-based
reader can split, and braces inside strings rule out splitting by pattern.
``split_landing`` takes objects as rows, which suits what a delivery service of
bounded objects writes. ``split_large`` reads objects of any size by byte ranges:
the text reader cuts them behind every closing brace, whatever that brace means,
and prefix sums over the pieces tell which of them end a value.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SPLIT_SCHEMA = "path string, position long, record string, error string"

_ARROW_SCHEMA = pa.schema([
    ("path", pa.string()), ("position", pa.int64()), ("record", pa.string()), ("error", pa.string()),
])

# Send the splitter itself to the Python workers, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACE = re.compile(r"\s*")

# Rows per outgoing Arrow batch.
_BATCH_ROWS = 4096


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, body) per landing object below a folder; blank objects are left out."""
    # The argument, not the option: the argument's default would override the option.
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    bodies = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return bodies.where(F.col("body").rlike(r"\S"))


def _json_values(body: str) -> Iterator[tuple[str, str | None]]:
    """Each value as one line of JSON, as it was written if that is a line; on a broken value the rest of the body with the error."""
    decoder = json.JSONDecoder()
    at = _SPACE.match(body).end()
    while at < len(body):
        try:
            value, end = decoder.raw_decode(body, at)
        except ValueError as error:
            yield body[at:], str(error)
            return
        written = body[at:end]
        yield (json.dumps(value) if "\n" in written or "\r" in written else written), None
        at = _SPACE.match(body, end).end()


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, body in zip(batch.column(0), batch.column(1)):
            rows: list[tuple] = []
            for position, (record, error) in enumerate(_json_values(body.as_py())):
                rows.append((path.as_py(), position, record, error))
                if len(rows) == _BATCH_ROWS:
                    yield _to_batch(rows)
                    rows = []
            if rows:
                yield _to_batch(rows)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW_SCHEMA.types)], schema=_ARROW_SCHEMA)


def split_landing(bodies: DataFrame) -> DataFrame:
    """One row per JSON value: (path, position, record, error).

    A broken value ends its object: the row holds the remaining text and the
    error, and the values before it are kept.
    """
    return bodies.select("path", "body").mapInArrow(_split_batches, SPLIT_SCHEMA)


# ---------------------------------------------------------------- objects of any size

#: What stands in the error column of values behind a broken one.
AFTER_BROKEN = "after a broken value"

_PIECE = ["path", "block", "id"]


def _outside(text: Column) -> Column:
    """Text that begins outside a string, without escapes, strings and what follows an open one."""
    return F.regexp_replace(text, r'"[^"]*("|$)', "")


def _depth(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    opened = F.length(F.regexp_replace(text, r"[^\[{]", ""))
    return (opened - F.length(F.regexp_replace(text, r"[^\]}]", ""))).cast("long")


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The objects below a folder cut behind every closing brace, read by byte ranges (blocks).

    ``closed`` says whether a brace stood there; only the last piece of an object
    may lack it. ``quotes``, ``depth_out`` and ``depth_in`` are what the piece does
    to a reader who is outside or inside a string at its start: it changes that if
    the number of quotes is odd, and moves it by so many levels. A piece follows a
    brace or begins an object, so no escape reaches into it.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="}")
    pieces = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"),
    )
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    inside = F.regexp_replace(plain, r'^[^"]*("|$)', "")
    quotes = F.length(F.regexp_replace(plain, r'[^"]', "")) % 2
    # The brace itself closes a level where it is not within a string.
    return pieces.select(
        *_PIECE, "text", "_size", quotes.cast("long").alias("quotes"),
        (_depth(_outside(plain)) - F.when(quotes == 0, 1).otherwise(0)).alias("depth_out"),
        (_depth(_outside(inside)) - F.when(quotes == 1, 1).otherwise(0)).alias("depth_in"),
    )


def _before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _whole_values(pieces: DataFrame) -> DataFrame:
    """Pieces with ``chunk``: the number of places before them in their object where no value was open.

    Sums run within a block first, for a reader who begins it outside or inside a
    string, and then over the blocks of an object, so no task holds an object.
    """
    inner, outer = Window.partitionBy("path", "block").orderBy("id"), Window.partitionBy("path").orderBy("block")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flipped = pieces.withColumn("flips", _before(F.col("quotes"), inner) % 2)
    out_first = F.when(F.col("flips") == 0, F.col("depth_out")).otherwise(F.col("depth_in"))
    in_first = F.when(F.col("flips") == 0, F.col("depth_in")).otherwise(F.col("depth_out"))
    local = flipped.withColumns({"level_out": F.sum(out_first).over(upto), "level_in": F.sum(in_first).over(upto)})

    blocks = local.groupBy("path", "block").agg(
        (F.sum("quotes") % 2).alias("_quotes"), F.max_by("level_out", "id").alias("_out"), F.max_by("level_in", "id").alias("_in"),
        F.sum(F.octet_length("text") + 1).alias("_bytes"), F.max("_size").alias("_size"), F.max("id").alias("_last"),
    )
    started = blocks.withColumn("_inside", _before(F.col("_quotes"), outer) % 2)
    moved = F.when(F.col("_inside") == 0, F.col("_out")).otherwise(F.col("_in"))
    started = started.withColumn("_level", _before(moved, outer))
    # The reader leaves the closing brace out; one byte too many means that the last piece had none.
    over = F.sum("_bytes").over(Window.partitionBy("path")) > F.col("_size")
    ends = started.select(
        "path", "block", "_inside", "_level",
        F.when(over & (F.col("block") == F.max("block").over(Window.partitionBy("path"))), F.col("_last")).alias("_open"),
    )
    placed = local.drop("_size").join(ends, ["path", "block"])
    level = F.col("_level") + F.when(F.col("_inside") == 0, F.col("level_out")).otherwise(F.col("level_in"))
    in_string = (F.col("_inside") + F.col("flips") + F.col("quotes")) % 2 == 1
    placed = placed.select(
        *_PIECE, "text", F.coalesce(F.col("id") != F.col("_open"), F.lit(True)).alias("closed"),
        (~in_string & (level <= 0)).cast("long").alias("ends"),
    )
    counted = placed.withColumn("_own", _before(F.col("ends"), inner))
    totals = placed.groupBy("path", "block").agg(F.sum("ends").alias("_ends"))
    totals = totals.select("path", "block", _before(F.col("_ends"), outer).alias("_sofar"))
    return counted.join(totals, ["path", "block"]).select(*_PIECE, "text", "closed", (F.col("_own") + F.col("_sofar")).alias("chunk"))


def _split_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (path, block, chunk, at, record, error)
            for path, block, chunk, body in zip(*(batch.column(i).to_pylist() for i in range(4)))
            for at, (record, error) in enumerate(_json_values(body))
        ]
        columns = zip(*rows) if rows else [[]] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["path", "block", "chunk", "at", "record", "error"]
        )


def split_large(spark: SparkSession, path: str, work: str) -> DataFrame:
    """One row per JSON value, as ``split_landing`` gives them, of objects of any size.

    Values are the same and have the same positions. What follows a broken value
    is not one row but one per value or chunk, all with an error. Values at the top
    level that are not objects are found too, but nothing cuts an object that holds
    no closing brace. Intermediate tables go below ``work``.
    """
    root = work.rstrip("/")
    read_pieces(spark, path).write.parquet(f"{root}/pieces")
    pieces = _whole_values(spark.read.parquet(f"{root}/pieces"))
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "}")
    bodies = pieces.groupBy("path", "chunk").agg(
        F.min("block").alias("block"), F.concat(text, F.when(F.min("closed"), F.lit("}")).otherwise(F.lit(""))).alias("body")
    )
    schema = "path string, block long, chunk long, at long, record string, error string"
    bodies.select("path", "block", "chunk", "body").mapInArrow(_split_chunks, schema).write.parquet(f"{root}/values")
    values = spark.read.parquet(f"{root}/values")
    inner, outer = Window.partitionBy("path", "block").orderBy("chunk", "at"), Window.partitionBy("path").orderBy("block")
    counts = values.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("path", "block", _before(F.col("_n"), outer).alias("_sofar"))
    broken = values.where("error is not null").groupBy("path").agg(F.min("chunk").alias("_broken"))
    numbered = values.withColumn("_own", F.row_number().over(inner) - 1).join(counts, ["path", "block"]).join(broken, "path", "left")
    error = F.when(F.col("error").isNull() & (F.col("chunk") > F.col("_broken")), F.lit(AFTER_BROKEN)).otherwise(F.col("error"))
    return numbered.select("path", (F.col("_own") + F.col("_sofar")).alias("position"), "record", error.alias("error"))
