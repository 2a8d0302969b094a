"""Token counts of whole texts, huge ones in overlapping chunks (operator 7).

A text beyond ``chunk`` characters is cut, in one pass, into rows, each with the
characters of its chunk and an overlap into the next one. Each is encoded with
offsets. A splice is the first place from the chunk's start on where an ASCII white
space follows something else: there the byte-level pattern must cut, so the tokens on
either side don't depend on what stands further away, and both neighbours find the
same place. An overlap without such a place is widened until it has one or the text
ends; chunks that lie before it whole are not encoded, as the chunk before them has
their tokens. So a text is encoded twice over at most. A splice must also be a token
boundary of both encodings, which is checked. A place that isn't is passed over, with
a wider stretch each time, and the two chunks that meet there are encoded again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from editpulse.llm.common import Scratch, documents, partitions, tokenizer_file, two_hashes, whole
from editpulse.llm.tokens import ODD_SPACES, span_counts, tokenizer

CHUNK, OVERLAP = 1 << 15, 1 << 10
LIMIT = 512
SPLICE = re.compile(rf"(?<=[^\t-\r {ODD_SPACES}])[\t-\r ]")
CUT = "_t1 long, _t2 long, _chunk long, _base long, _head long, _tail long, _text string"
COUNTED = "_t1 long, _t2 long, _chunk long, _n long, _bad array<long>"
#: A task hands on chunks of a text when they hold so many characters.
HANDED = 1 << 21


def splices(text: str, chunk: int, bad: list[tuple[int, int]]) -> list[int]:
    """Where each chunk's part begins, and the end of the text: the first stable place from the chunk's start on.

    ``bad`` lists stretches (first, end) whose places are passed over. The text is
    searched once, as a place beyond the next chunk's start is also that one's.
    """
    places, place = [0], 0
    for start in range(chunk, len(text), chunk):
        if place < start:
            at = start
            while True:
                found = SPLICE.search(text, at)
                place = found.start() if found else len(text)
                ends = [end for first, end in bad if first <= place < end]
                if not found or not ends:
                    break
                at = max(ends)
        places.append(place)
    return [*places, len(text)]


def cut(text: str, chunk: int, overlap: int, bad: list[tuple[int, int]], new: set[int]) -> Iterator[tuple[int, int, int, int, str]]:
    """_chunk, _base, _head, _tail, _text of the chunks to encode: those with a part of their own; later, those whose part ``new`` changes.

    A chunk begins one character before its start, so both neighbours see a
    boundary there, and overlaps the next by as much as it takes to hold the next
    splice and ``overlap`` characters.
    """
    places = splices(text, chunk, bad)
    before = splices(text, chunk, [b for b in bad if b[0] not in new]) if new else places
    for k, (head, tail) in enumerate(zip(places, places[1:])):
        if new and before[k : k + 2] == [head, tail]:
            continue
        if head == tail:
            if new:  # counted before, nothing now
                yield k, 0, 0, 0, ""
            continue
        base = max(k * chunk - 1, 0)
        yield k, base, head, tail, text[base : tail + overlap]


def cut_texts(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*[(c, pa.int64()) for c in ("_t1", "_t2", "_chunk", "_base", "_head", "_tail")], ("_text", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            t1, t2, text, first, end, new = (batch.column(c)[i].as_py() for c in ("_t1", "_t2", "_text", "_first", "_end", "_new"))
            for row in cut(text, chunk, overlap, list(zip(first, end)), set(new)):
                rows.append((t1, t2, *row))
                held += len(row[-1])
                if held >= HANDED:
                    yield batch_of(rows)
                    rows, held = [], 0
    if rows:
        yield batch_of(rows)


def count_chunk(path: str, text: str, base: int, head: int, tail: int) -> tuple[int, list[int]]:
    """The tokens from head to tail (in characters of the whole text, ``text`` from ``base`` on), and which of them are no token boundaries."""
    if head == tail:
        return 0, []
    offsets = tokenizer(path).encode(text, add_special_tokens=False).offsets
    starts = [a for a, _ in offsets]

    def token_at(place: int) -> int:
        """The first token from there on; -1 if one reaches across."""
        if place == base + len(text):
            return len(starts)
        i = bisect_left(starts, place - base)
        clean = i < len(starts) and starts[i] == place - base and (i == 0 or offsets[i - 1][1] <= place - base)
        return i if clean else -1

    first, last = token_at(head) if head else 0, token_at(tail)
    return last - first, [place for place, token in ((head, first), (tail, last)) if token < 0]


def count_chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, places = batch.column("_text"), [batch.column(c).to_pylist() for c in ("_base", "_head", "_tail")]
        found = [count_chunk(path, texts[i].as_py(), *row) for i, row in enumerate(zip(*places))]
        counts, bad = pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_t1", "_t2", "_chunk")], counts, bad], ["_t1", "_t2", "_chunk", "_n", "_bad"])


def count_short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.array(span_counts(path, batch.column("_text").to_pylist()), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])


def count_long(texts: DataFrame, scratch: Scratch, path: str, chunk: int, overlap: int) -> DataFrame:
    """_t1, _t2, n_tokens for texts (_t1, _t2, _text); a text may come as several rows."""
    none = F.array().cast("array<long>")
    todo = texts.withColumns({"_first": none, "_end": none, "_new": none})
    rounds, passed = [], []
    while True:
        level = len(rounds)
        # Chunks of one text go to many tasks.
        rows = todo.mapInArrow(partial(cut_texts, chunk=chunk, overlap=overlap), CUT)
        rows = rows.repartition(partitions(scratch.spark), "_t1", "_chunk")
        counts = scratch.table(rows.mapInArrow(partial(count_chunks, path=path), COUNTED), f"chunks-{level}")
        once = counts.groupBy("_t1", "_t2", "_chunk").agg(F.first("_n").alias("_n"), F.first("_bad").alias("_bad"))
        rounds.append(once.withColumn("_round", F.lit(level)))
        bad = scratch.table(once.select("_t1", "_t2", F.explode("_bad").alias("_place")).distinct(), f"bad-{level}")
        if bad.isEmpty():
            break
        passed.append(bad.withColumns({"_until": F.col("_place") + (overlap << level), "_round": F.lit(level)}))
        known = reduce(DataFrame.unionByName, passed).groupBy("_t1", "_t2").agg(
            F.collect_list("_place").alias("_first"), F.collect_list("_until").alias("_end"),
            F.collect_list(F.when(F.col("_round") == level, F.col("_place"))).alias("_new"),
        )
        todo = texts.join(known.where("size(_new) > 0"), ["_t1", "_t2"])
    counted = reduce(DataFrame.unionByName, rounds)
    if len(rounds) > 1:  # the last word on each chunk
        counted = counted.groupBy("_t1", "_t2", "_chunk").agg(F.max_by("_n", "_round").alias("_n"))
    return counted.groupBy("_t1", "_t2").agg(F.sum("_n").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs``.

    Null and empty texts have none. A long text is identified by 128 bits of
    hash, so repeated and null doc_ids and repeated rows all get their counts.
    Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    path = path or tokenizer_file("byte_bpe_50k.json")
    rows = docs.select("doc_id", whole().alias("_text")).withColumn("n_bytes", F.octet_length("_text").cast("long"))
    long = F.length("_text") > chunk
    short = rows.where(~long).mapInArrow(partial(count_short, path=path), "doc_id long, n_bytes long, n_tokens long")
    a, b = two_hashes(F.col("_text"))
    huge = rows.where(long).select("doc_id", "n_bytes", "_text", a.alias("_t1"), b.alias("_t2"))
    counts = count_long(huge.select("_t1", "_t2", "_text"), scratch, path, chunk, overlap)
    return short.unionByName(huge.select("doc_id", "n_bytes", "_t1", "_t2").join(counts, ["_t1", "_t2"]).drop("_t1", "_t2"))


def op7_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
