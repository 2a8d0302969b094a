"""Line dedup over the corpus (operator 10), on built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from editpulse.llm.common import LOWER, NO_ID, SPACES, UPPER, Scratch, documents, two_hashes, whole

MIN_CHARS, MIN_DOCS = 20, 3


def split_lines(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but the text), ``lines``, and what identifies the row: ``id`` and two hashes of its text."""
    a, b = two_hashes(whole())
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(
        F.struct(*others).alias("row"), F.split(whole(), "\n", -1).alias("lines"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), a.alias("t1"), b.alias("t2"),
    )


def repeated_lines(docs: DataFrame, scratch: Scratch, min_chars: int, min_docs: int) -> DataFrame:
    """Per row that loses lines: id, t1, t2 and ``gone``, the positions of those lines."""
    exploded = split_lines(docs.select("doc_id", "text")).select("id", "t1", "t2", F.posexplode("lines").alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER)
    keyed = exploded.select("id", "t1", "t2", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    a, b = two_hashes(F.col("key"))
    # The hashes of the lines, not the lines, are what is counted and joined.
    keyed = scratch.table(keyed.select("id", "t1", "t2", "pos", a.alias("k1"), b.alias("k2")), "keys")
    # A document's own repeats fall together before the shuffle, and a common line is counted in parts dealt by document.
    held = keyed.groupBy("k1", "k2").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last"))
    common = scratch.table(held.where(F.col("docs") >= min_docs).drop("docs"), "common")
    lost = keyed.join(common, ["k1", "k2"]).where(F.col("id") != F.col("last"))
    return lost.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs``: ``row``, a struct of all its columns but the text, and ``lines`` and ``kept``, arrays.

    A line's key is the line, stripped and with A-Z lowered. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all their
    lines but those of the largest doc_id. Null text is empty; an empty text is
    one empty line. Rows with one doc_id are one document, and so are all rows
    without; those count as the smallest. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    gone = repeated_lines(docs, scratch, min_chars, min_docs)
    rows = split_lines(docs).join(gone, ["id", "t1", "t2"], "left")
    # Both steps are linear in the number of lines; the lines come out of the join as a column, so they are split once.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get(F.col("lines"), i)))
    return rows.select("row", "lines", kept.alias("kept"))


def op10_line_dedup(spark, sf_dir):
    rows = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )
