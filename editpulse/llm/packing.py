"""Vector bin packing of tokenised documents into sequences (operator 1).

A document's ids are cut into pieces of ``limit`` ids and a rest. Full pieces are
sequences of their own. The rests are examples with three demands: tokens, one
segment, and loss-bearing tokens (all but the first, which nothing precedes). They
are dealt at random into blocks of bounded size, and each block is packed on its
own: the open sequence takes, of the examples that fit in all three, the one whose
demands have the largest weighted dot product with the room that is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from editpulse.llm.common import Scratch, documents, tokenizer_file
from editpulse.llm.tokens import text_ids

LIMIT, SEGMENTS = 4096, 1024
END = 2
#: Examples of a block at most about; a block loses part of a sequence at its end.
BLOCK = 2048
#: Texts grow several times over in a worker, and several workers share an executor.
BATCH_BYTES = "4m"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut(batches: Iterator[pa.RecordBatch], path: str, limit: int, end: int) -> Iterator[pa.RecordBatch]:
    tail = np.array([end], dtype="<u4").tobytes()
    for batch in batches:
        columns = [[], [], [], [], []]
        if not batch.num_rows:
            continue
        texts = text_ids(path, pc.fill_null(batch.column("text"), ""))
        for doc, found in zip(batch.column("doc_id").to_pylist(), texts):
            ids = found.tobytes() + tail
            n = len(ids) // 4
            for start in range(0, n, limit):
                piece = ids[4 * start : 4 * (start + limit)]
                for column, value in zip(columns, (doc, start, len(piece) // 4, zlib.crc32(piece), n)):
                    column.append(value)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def place(demands: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For examples by row: the sequence and the place in it (in tokens, the first demand).

    Examples with equal demands are of one kind; a step scores the kinds that fit.
    """
    kinds, kind_of, counts = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    if (kinds > capacity).any():
        raise ValueError("an example exceeds the limits of a sequence")
    shares = kinds / capacity
    weights = (shares * counts[:, None]).sum(axis=0)
    weighted = shares * (weights / weights.sum())
    order = np.argsort(kind_of.ravel(), kind="stable")
    next_of = np.concatenate([[0], np.cumsum(counts)[:-1]])
    left = counts.copy()
    sequence, offset = np.empty(len(demands), np.int64), np.empty(len(demands), np.int64)
    room, now, rest = capacity.copy(), 0, len(demands)
    alive = np.arange(len(kinds))
    while rest:
        fits = alive[(kinds[alive] <= room).all(axis=1) & (left[alive] > 0)]
        if not len(fits):
            room, now = capacity.copy(), now + 1
            alive = np.flatnonzero(left)
            continue
        best = fits[np.argmax(weighted[fits] @ (room / capacity))]
        i = order[next_of[best]]
        sequence[i], offset[i] = now, capacity[0] - room[0]
        room = room - kinds[best]
        next_of[best] += 1
        left[best] -= 1
        rest -= 1
        alive = fits
    return sequence, offset


def pack_block(rows: pa.Table, limit: int, segments: int) -> pa.Table:
    """One block; full pieces get a sequence each behind the packed ones."""
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
    length = rows["length"].to_numpy()
    rests, full = np.flatnonzero(length < limit), np.flatnonzero(length >= limit)
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    used = 0
    if len(rests):
        demands = np.column_stack([length[rests], np.ones(len(rests), np.int64), length[rests] - 1])
        sequence[rests], offset[rests] = place(demands, np.array([limit, segments, limit]))
        used = int(sequence[rests].max()) + 1
    sequence[full] = used + np.arange(len(full))
    block = rows["_block"].to_numpy()
    return rows.drop_columns("_block").append_column("sequence_id", pa.array((block << 32) | sequence)).append_column("offset", pa.array(offset))


def pack(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, segments: int = SEGMENTS, end: int = END, block: int = BLOCK
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Texts of any length are read
    whole. Each row of ``docs`` is packed, also when rows or doc_ids repeat or
    doc_ids are null. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    path = path or tokenizer_file("word_bpe_49k.json")
    pieces = scratch.table(docs.select("doc_id", "text").mapInArrow(partial(cut, path=path, limit=limit, end=end), PIECES), "pieces")
    blocks = pieces.count() // block + 1
    # Repeated rows go to different blocks as well as others do: the block also depends on where the row is.
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(blocks)))

    def packed(rows: pa.Table) -> pa.Table:
        return pack_block(rows, limit, segments)

    return dealt.groupBy("_block").applyInArrow(packed, PACKED)


def op1_pack_documents(spark, sf_dir):
    return pack(documents(spark, sf_dir))
