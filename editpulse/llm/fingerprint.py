"""Lempel-Ziv phrase fingerprints of documents (operator 11).

A text is parsed over its UTF-8 bytes into dictionary phrases: the longest phrase
known so far, with one more byte, becomes the next phrase. Each phrase has a
64-bit hash, which goes by its bytes alone. The set of hashes is cut into BINS by
its high bits, and the least of each bin leaves 8 bits in the fingerprint (00: the
bin is empty). The share of bins that agree, among those that either set fills,
estimates the Jaccard likeness of the phrase sets, less what bins agree by chance.

Each document is compared with its edited text, which ends in the beginning of the
next document. Rows are sorted by doc_id over range partitions, the only exchange
of texts, so the next document is the next row. What the last row of a partition
lacks is in the first row of the next one: both are written out with their texts,
two a partition, and meet in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from editpulse.llm.common import Scratch, documents, whole

BINS = 256
#: Factor of the phrase hash (a prime), and the multipliers of its final mixing.
PRIME, MIX_1, MIX_2 = 1_099_511_628_211, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
MASK = (1 << 64) - 1
#: Digests are bytes until the result is returned; written as text they would take twice the room.
BINARY = ("edited_sha256", "fingerprint", "edited_fingerprint")
COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)
ROW, LAST, FIRST = 0, 1, 2


class Parser:
    """The phrases of a text, which may be gone back on to a mark and continued otherwise."""

    def __init__(self) -> None:
        self.tree: dict[int, int] = {}  # (phrase, byte) -> longer phrase; insertion order is that of the numbers
        self.hashes = [0]
        self.at = 0

    def feed(self, data: bytes) -> None:
        tree, hashes, at = self.tree, self.hashes, self.at
        get = tree.get
        for byte in data:
            key = at << 8 | byte
            longer = get(key)
            if longer is None:
                tree[key] = len(hashes)
                hashes.append((hashes[at] * PRIME + byte + 1) & MASK)
                at = 0
            else:
                at = longer
        self.at = at

    def mark(self) -> tuple[int, int]:
        return len(self.hashes), self.at

    def go_back(self, mark: tuple[int, int]) -> None:
        size, self.at = mark
        del self.hashes[size:]
        while len(self.tree) >= size:
            self.tree.popitem()

    def fingerprint(self) -> bytes:
        return sketch(np.array(self.hashes[1:], np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """8 bits of the least hash of each bin."""
    x = hashes ^ (hashes >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(MIX_2)
    x ^= x >> np.uint64(33)
    x.sort()
    bins = (x >> np.uint64(56)).astype(np.int64)
    least, first = np.unique(bins, return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[least] = 1 + (x[first] & np.uint64(0xFFFFFFFF)) % np.uint64(255)
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard likeness of two phrase sets; 1 of two empty ones."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    filled = (x != 0) | (y != 0)
    if not filled.any():
        return 1.0
    share = float((x == y)[filled].mean())
    return max(0.0, (share - 1 / 255) / (1 - 1 / 255))


def fingerprint(text: str) -> bytes:
    parser = Parser()
    parser.feed(text.encode())
    return parser.fingerprint()


def compared(doc_id, text: str, following: str, own: bytes | None = None) -> tuple:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited of a document and the text that comes next.

    Both fingerprints come from one parse of the common beginning; one that is known is not made again.
    """
    half = len(text) // 2
    head, tail, other = text[: len(text) - half].encode(), text[len(text) - half :].encode(), following[:half].encode()
    parser = Parser()
    parser.feed(head)
    mark = parser.mark()
    parser.feed(other)
    edited = parser.fingerprint()
    if own is None:
        parser.go_back(mark)
        parser.feed(tail)
        own = parser.fingerprint()
    return doc_id, len(text), hashlib.sha256(head + other).digest(), own, edited, likeness(own, edited)


FIELDS = [
    ("kind", pa.int32()), ("part", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def as_batch(rows: list[tuple], fields: list[tuple] = FIELDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: results of all rows but the last, and the first and last row themselves.

    A result needs the next row's fingerprint, which is made when that row is the current one; so it waits for one row.
    """
    part = TaskContext.get().partitionId()
    held, waiting, first = None, None, True
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
            if held is not None:
                row = compared(*held, text)
                if waiting is not None:
                    rows.append((ROW, None, None, *waiting, likeness(waiting[3], row[3])))
                if first:
                    rows.append((FIRST, part, held[1], held[0], row[1], None, row[3], None, None, None))
                    first = False
                waiting = row
            held = doc_id, text
        if rows:
            yield as_batch(rows)
    if held is not None:
        own = fingerprint(held[1])
        rows = [(ROW, None, None, *waiting, likeness(waiting[3], own))] if waiting is not None else []
        end = part, held[1], held[0], len(held[1]), None, own, None, None, None
        yield as_batch(rows + ([(FIRST, *end)] if first else []) + [(LAST, *end)])


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions, each with the first row of the next one -> their results."""
    for batch in batches:
        rows = [
            (*compared(r["doc_id"], r["text"], r["next_text"], r["fingerprint"]), likeness(r["fingerprint"], r["next_fingerprint"]))
            for r in batch.to_pylist()
        ]
        if rows:
            yield as_batch(rows, FIELDS[3:])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id, after the last the first;
    a table of one row follows itself. A null doc_id comes last; rows of one doc_id
    follow by a hash of their text, and equal rows in any order, which leaves the
    rows of the result the same. Null text counts as empty; two empty texts have a
    likeness of 1, an empty and another one of 0. Other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), F.xxhash64(whole()).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),  # deals equal rows to several partitions
    )
    order = [F.desc_nulls_last("doc_id"), F.asc("_hash"), F.asc("_row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = scratch.table(placed.mapInArrow(neighbours, f"kind int, part long, text string, {COLUMNS}"), "found")
    firsts = found.where(F.col("kind") == FIRST)
    # As many rows as partitions, without their texts.
    parts = firsts.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    parts = parts.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    heads = firsts.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = found.where(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint").join(parts, "part").join(heads, "next")
    result = found.where(F.col("kind") == ROW)
    names = [n for n, _ in FIELDS[3:]]
    result = result.select(*names).unionByName(last.drop("next", "part").mapInArrow(ends, COLUMNS))
    return result.withColumns({c: F.lower(F.hex(c)) for c in BINARY})


def op11_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
