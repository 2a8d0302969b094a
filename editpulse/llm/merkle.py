"""Merkle manifest of a table by butterfly exchange (operator 12).

The leaves of a source are numbered by doc_id and cut into aligned blocks of
FANOUT ** HEIGHT; a block is hashed to its subtree root by itself. Then the blocks
exchange roots: in round r, those that differ only in digit r of their number (in
base FANOUT), at most FANOUT of them, swap the roots of the subtrees they stand in.
Each of them keeps what it got as the next part of its proof, and each hashes the
same parent. After the last round every block has its whole upper proof and the
root; nothing is handed down the tree. Where the number of blocks is no power of
FANOUT, missing numbers are blocks without leaves: they have no root, and take part
so that every block finds its partners. The roots of sources are exchanged in the
same way, and each block then takes the proof of its source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from editpulse.llm.common import Scratch, documents

FANOUT, HEIGHT = 3, 6
STEP = "struct<left:string,right:string>"
RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(column: Column) -> Column:
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(text: Column) -> Column:
    """The leaf of a row with this text in place of its own."""
    fields = [encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, encoded(text)), 256)


def numbered(rows: DataFrame, order: list[Column], by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows with ``rank`` (from 0, by ``order`` within ``by``) and ``total``, the number of rows of ``by``.

    ``order`` begins with ``by``. Rows are sorted over range partitions; a rank is
    the place in the partition and the count of the same ``by`` in those before it,
    so that no task holds all rows of one.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = scratch.table(placed, name).withColumn("_part", F.shiftright("_place", 33))
    runs = placed.groupBy("_part", *by).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in by],
        (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"),
    )
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    numbers = (F.col("_place") + F.col("_shift")).alias("rank")
    return placed.join(starts, same).select(*rows.columns, numbers, "total")


def rounds_for(nodes: int) -> int:
    """How often runs of FANOUT are merged until one node is left."""
    rounds = 0
    while FANOUT**rounds < nodes:
        rounds += 1
    return rounds


def butterfly(nodes: DataFrame, by: list[str], most: int) -> DataFrame:
    """Per node (``by``, ``lane``, ``lanes``, ``root``): the root of all lanes as ``top``, and the ``path`` to it.

    ``lanes`` is the number of nodes of the same ``by``, at most ``most``. The path
    has a step for each round: the hashes left and right of the node's own.
    """
    width = F.lit(1).cast("long")
    for r in range(rounds_for(most)):
        width = F.when(F.col("lanes") > FANOUT**r, F.lit(FANOUT ** (r + 1)).cast("long")).otherwise(width)
    # Each node stands for the lanes without leaves that lie whole multiples of ``lanes`` after it: FANOUT - 1 of them at most.
    state = nodes.withColumn("width", width).withColumn("own", F.col("lane"))
    state = state.withColumn("lane", F.explode(F.sequence("own", F.col("width") - 1, "lanes"))).select(
        *by, "lane", "lanes", "width", (F.col("lane") == F.col("own")).alias("real"),
        F.when(F.col("lane") == F.col("own"), F.col("root")).alias("top"), F.array().cast(f"array<{STEP}>").alias("path"),
    )
    for r in range(rounds_for(most)):
        step = FANOUT**r
        digit = F.pmod(F.call_function("div", F.col("lane"), F.lit(step)), F.lit(FANOUT))
        group = Window.partitionBy(*by, F.col("lane") - digit * step)
        got = [f"_got{j}" for j in range(FANOUT)]
        state = state.select("*", digit.alias("_digit"), *[F.max(F.when(digit == j, F.col("top"))).over(group).alias(g) for j, g in enumerate(got)])
        left = F.concat_ws("", *[F.when(F.col("_digit") > j, F.col(g)) for j, g in enumerate(got)])
        right = F.concat_ws("", *[F.when(F.col("_digit") < j, F.col(g)) for j, g in enumerate(got)])
        parent = F.when(F.coalesce(*got).isNotNull(), F.sha2(F.concat_ws("", *got), 256))
        open_ = F.col("width") > step
        state = state.select(
            *by, "lane", "lanes", "width", "real", F.when(open_, parent).otherwise(F.col("top")).alias("top"),
            F.when(open_, F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("path")).alias("path"),
        )
    return state.where("real").drop("real", "width")


def subtree(leaves: list[str], height: int | None) -> list[list[str]]:
    """The levels of a block from its leaves up: ``height`` merges, or with None until one node is left."""
    levels = [leaves]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def height_of(total: int, height: int) -> int | None:
    """A source of one block ends where one node is left; others go on above whole blocks."""
    return height if total > FANOUT**height else None


def block_roots(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves = [[r["leaf"] for r in rows] for rows in batch.column("rows").to_pylist()]
        roots = [subtree(x, height_of(n, height))[-1][0] for x, n in zip(leaves, batch.column("total").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("source"), batch.column("block"), batch.column("total"), pa.array(roots, pa.string())], ["source", "block", "total", "root"]
        )


def inner_path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf's node on each level of its block."""
    path = []
    for level in levels[:-1]:
        run = at - at % FANOUT
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + FANOUT])))
        at //= FANOUT
    return path


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


def prove(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Blocks with their upper paths -> a row per leaf. A proof is checked by folding it, not by what was hashed before."""
    for batch in batches:
        for block in batch.to_pylist():
            levels = subtree([r["leaf"] for r in block["rows"]], height_of(block["total"], height))
            upper = [(s["left"], s["right"]) for s in (*block["path"], *block["source_path"])]
            tail, out = "".join(a + b for a, b in upper), []
            for at, row in enumerate(block["rows"]):
                path = inner_path(levels, at)
                proof = digest(*(a + b for a, b in path), tail)
                folded = fold(fold(row["tampered"] or row["leaf"], path), upper)
                out.append((row["doc_id"], row["leaf"], block["top"], block["source_top"], proof, folded, folded == block["source_top"]))
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            types = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def greatest(frame: DataFrame, column: str) -> int:
    return frame.agg(F.max(column)).first()[0] or 0


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    A null field counts as `-`, so it differs from an empty one; a null source is a
    source of its own, the first. Within a source a null doc_id comes first, rows of
    one doc_id follow by their leaf, and equal rows have proofs of their own. A row
    with a null doc_id is not tampered with. A table of one row is its own root, with
    an empty proof. Other columns are ignored; an empty table gives no rows. ``height``
    is that of a block and does not change the result.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False)) & F.col("text").contains("\n")
    cut = docs.select("doc_id", "source", "lang", "n_chars", "text", F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).alias("_cut"))
    leaves = cut.select(
        "doc_id", "source", leaf_of(F.col("text")).alias("leaf"), F.when(F.col("_cut").isNotNull(), leaf_of(F.col("_cut"))).alias("tampered"),
        F.monotonically_increasing_id().alias("_row"),  # deals equal rows to several partitions
    )
    leaves = scratch.table(leaves, "hashed")
    ranked = numbered(leaves, [F.asc(c) for c in ("source", "doc_id", "leaf", "_row")], ["source"], scratch, "sorted")
    block = F.call_function("div", F.col("rank"), F.lit(FANOUT**height))
    row = F.struct("rank", "doc_id", "leaf", "tampered")
    blocks = ranked.groupBy("source", block.alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = scratch.table(blocks, "blocks")
    scratch.drop("hashed", "sorted")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_roots(batches, height)

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return prove(batches, height)

    source_type = docs.schema["source"].dataType.simpleString()
    rooted = blocks.select("source", "block", "total", F.transform("rows", lambda r: F.struct(r["leaf"].alias("leaf"))).alias("rows"))
    rooted = scratch.table(rooted.mapInArrow(roots, f"source {source_type}, block long, total long, root string"), "roots")
    lanes = F.call_function("div", F.col("total") - 1, F.lit(FANOUT**height)) + 1
    nodes = rooted.select("source", F.col("block").alias("lane"), lanes.alias("lanes"), "root")
    exchanged = scratch.table(butterfly(nodes, ["source"], greatest(nodes, "lanes")), "exchanged")

    tops = exchanged.where("lane = 0").select("source", F.col("top").alias("root"))
    tops = numbered(tops, [F.asc("source")], [], scratch, "sources").withColumnsRenamed({"rank": "lane", "total": "lanes"})
    tops = scratch.table(tops, "tops")
    above = scratch.table(butterfly(tops.select("lane", "lanes", "root"), [], greatest(tops, "lanes")), "above")
    named = tops.select(F.col("source").alias("_source"), F.col("lane").alias("_lane"))
    above = named.join(above.select(F.col("lane").alias("_lane"), F.col("top").alias("source_top"), F.col("path").alias("source_path")), "_lane")
    upper = exchanged.join(above, F.col("source").eqNullSafe(F.col("_source")))
    upper = upper.select(F.col("source").alias("_s"), F.col("lane").alias("_block"), "top", "path", "source_top", "source_path")
    joined = blocks.join(upper, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_block")))
    return joined.select("total", "rows", "top", "path", "source_top", "source_path").mapInArrow(proofs, RESULT)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))
