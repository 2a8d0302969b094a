"""Near-duplicate vectors by sorted projection passes (operator 3).

Equal vectors of a label are one class. In each pass the classes are put in the
order of length, label and a key: sign hashes on random directions, drawn anew, of
what is left of the unit vector after its label's mean, then where it lies along one
more direction. Each class is compared with the classes of a bounded window before
it, and linked pairs of different groups are united. A round is some passes; rounds
go on, each with fresh directions and a wider window, until one joins nothing. The
members of each group are then compared with one another in blocks, which counts all
links within it, also those that no window held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from editpulse.llm.common import Scratch, two_hashes
from editpulse.llm.components import components, roots
from editpulse.session import configure

THRESHOLD, PASSES, BITS = 0.93, 4, 32
#: Classes before it that a class is compared with: in the first round, and at most.
WINDOW, WIDEST = 1024, 8192
#: The side of a tile: so many classes are compared with as many at a time.
TILE = 512
#: Bits of a key for the place along the last direction; steps of a mean's numbers.
PLACE_BITS, STEPS = 30, 1 << 24
#: A group has blocks of at least LEAST classes, FEW blocks if they are enough, and no block of more than about MOST numbers.
LEAST, FEW, MOST = 256, 8, 1 << 21
#: Classes of small groups that are counted together.
BIN = 1024


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    rows = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    rows = rows.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def linked_tile(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y are linked: in single precision, and in double what that leaves open."""
    margin = (x.shape[1] + 8) * 2.0**-23  # no sum of products of unit rows is further off
    near = x32 @ y32.T
    linked = near >= threshold - margin
    if linked.any():
        a, b = np.nonzero(linked & (near < threshold + margin))
        if 16 * len(a) > linked.size:
            return x @ y.T >= threshold
        linked[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return linked


def united(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Group numbers (each the place of a member) after the pairs (a, b) of groups are one."""
    tops = roots(a.tolist(), b.tolist())
    table = np.arange(len(group))
    table[list(tops)] = list(tops.values())
    return table[group]


def same_dim(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield batch.filter(pa.array(dims == dim))


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label of a batch: the number of its vectors and the sum of their unit vectors, in whole steps, so that order is nothing."""
    for batch in (part for whole in batches for part in same_dim(whole)):
        labels, inverse = np.unique(batch.column("label").to_numpy(), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        steps = np.rint(matrix(batch.column("embedding"))[order] * STEPS).astype(np.int64)
        counts = np.bincount(inverse)
        total = np.add.reduceat(steps, np.cumsum(counts) - counts, axis=0)
        dims = np.full(len(labels), batch.column("dim")[0].as_py(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(dims), pa.array(counts), pa.array(list(total))], ["label", "dim", "n", "steps"])


def centres(vectors: DataFrame) -> DataFrame:
    """label, dim, centre: the mean of the unit vectors."""
    parts = vectors.select("label", "dim", "embedding").mapInArrow(sums, "label long, dim int, n long, steps array<long>")
    each = parts.select("label", "dim", "n", F.posexplode("steps").alias("at", "step"))
    means = each.groupBy("label", "dim", "at").agg((F.sum("step") / F.sum("n") / F.lit(float(STEPS))).alias("mean"))
    pairs = F.array_sort(F.collect_list(F.struct("at", "mean")))  # as many as a vector has numbers
    return means.groupBy("label", "dim").agg(F.transform(pairs, lambda p: p["mean"]).alias("centre"))


def directions(seed: int, turn: int, dim: int, passes: int, bits: int) -> np.ndarray:
    drawn = np.random.default_rng([seed, turn, dim]).standard_normal((dim, passes * (bits + 1)))
    return drawn / np.linalg.norm(drawn, axis=0)


def placed(batches: Iterator[pa.RecordBatch], seed: int, turn: int, passes: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each vector once a pass, with its key there."""
    weights = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1, dtype=np.int64))
    for batch in (part for whole in batches for part in same_dim(whole)):
        dim = batch.column("dim")[0].as_py()
        centre = batch.column("centre").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        along = (matrix(batch.column("embedding")) - centre) @ directions(seed, turn, dim, passes, bits)
        along = along.reshape(-1, passes, bits + 1)
        # A difference of two vectors within the unit ball is not longer than 2.
        place = np.clip((along[:, :, -1] + 2) / 4 * (1 << PLACE_BITS), 0, (1 << PLACE_BITS) - 1).astype(np.int64)
        keys = ((along[:, :, :-1] > 0) @ weights << PLACE_BITS) | place
        for k in range(passes):
            columns = [batch.column("dim"), pa.array(np.full(len(keys), k, np.int32)), batch.column("label"), pa.array(keys[:, k])]
            columns += [batch.column(c) for c in ("class_id", "group", "embedding")]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "pass", "label", "key", "class_id", "group", "embedding"])


def window_forest(rows: pa.Table, fresh: int, threshold: float, window: int) -> pa.RecordBatch:
    """Groups that links of the rows from ``fresh`` on with those up to ``window`` before them join: group, first group here."""
    unit = matrix(rows["embedding"])
    single, n = unit.astype(np.float32), rows.num_rows
    label, step = rows["label"].to_numpy(), rows["pass"].to_numpy()
    part = np.concatenate([[0], np.cumsum((label[1:] != label[:-1]) | (step[1:] != step[:-1]))])
    names = rows["group"].to_numpy()
    _, first, of = np.unique(names, return_index=True, return_inverse=True)
    group = before = first[of]
    for b in range(fresh, n, TILE):
        y = slice(b, min(b + TILE, n))
        for a in [*range(max(0, b - window), b, TILE), b]:
            x = slice(a, min(a + TILE, b)) if a < b else y
            if part[x][-1] < part[b]:
                continue
            linked = linked_tile(unit[x], unit[y], single[x], single[y], threshold)
            if part[a] != part[y][-1]:
                linked &= part[x][:, None] == part[y][None, :]
            while True:  # one pair of each row at a time, until no pair is in two groups
                apart = linked & (group[x][:, None] != group[y][None, :])
                at = np.flatnonzero(apart.any(axis=1))
                if not len(at):
                    break
                group = united(group, group[a + at], group[b + apart[at].argmax(axis=1)])
    at = np.flatnonzero(group != before)
    return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[group[at]])], ["node", "parent"])


def windows(batches: Iterator[pa.RecordBatch], threshold: float, window: int) -> Iterator[pa.RecordBatch]:
    """The forests of a sorted partition; a batch also sees the window before it."""
    last = None
    for batch in (part for whole in batches if whole.num_rows for part in same_dim(whole)):
        rows, fresh = pa.Table.from_batches([batch]), 0
        if last is not None and last["dim"][0] == rows["dim"][0]:
            rows, fresh = pa.concat_tables([last, rows]), last.num_rows
        yield window_forest(rows, fresh, threshold, window)
        last = rows.slice(max(0, rows.num_rows - window))


def groups_of(vectors: DataFrame, scratch: Scratch, threshold: float, passes: int, bits: int, window: int, seed: int) -> DataFrame:
    """class_id, component: for the classes that rounds of passes link with others."""
    means = scratch.table(centres(vectors), "centres")
    # Spark broadcasts the means or the groups where they are small, and splits hot labels where not.
    centred = vectors.select("class_id", "label", "dim", "embedding").join(means, ["label", "dim"])
    children = scratch.spark.createDataFrame([], "class_id long, component long")
    order = ["dim", "pass", "label", "key", "class_id"]
    numbers = vectors.schema["embedding"].dataType.simpleString()
    schema = f"dim int, pass int, label long, key long, class_id long, group long, embedding {numbers}"
    turn = 0
    while True:
        known = centred.join(children, "class_id", "left").withColumn("group", F.coalesce("component", "class_id"))
        keys = known.drop("component").mapInArrow(partial(placed, seed=seed, turn=turn, passes=passes, bits=bits), schema)
        sorted_keys = keys.repartitionByRange(*order).sortWithinPartitions(*order)
        found = sorted_keys.mapInArrow(partial(windows, threshold=threshold, window=window), "node long, parent long")
        found = scratch.table(found.distinct(), f"found-{turn}")
        if found.isEmpty():
            break
        links = found.unionByName(children.select(F.col("class_id").alias("node"), F.col("component").alias("parent")))
        children = components(links, scratch, f"groups-{turn}").select(F.col("node").alias("class_id"), F.col("parent").alias("component"))
        turn, window = turn + 1, min(2 * window, max(window, WIDEST))
    tops = children.select(F.col("component").alias("class_id"), "component").distinct()
    return scratch.table(children.unionByName(tops), "groups")


def block_links(rows: pa.Table, threshold: float) -> pa.Table:
    """Of two blocks of a group (or one with itself, or of some small groups): the number of links of each class."""
    rows = rows.sort_by("_side")
    alone = rows["_i"][0].as_py() == rows["_j"][0].as_py()
    unit, ids, copies = matrix(rows["embedding"]), rows["class_id"].to_numpy(), rows["copies"].to_numpy().astype(np.float64)
    group = rows["component"].to_numpy()
    single, n = unit.astype(np.float32), rows.num_rows
    firsts = n if alone else int((rows["_side"].to_numpy() == 0).sum())
    several = len(np.unique(group)) > 1
    links = np.zeros(n)  # counts stay whole far beyond the rows of any table
    for a in range(0, firsts, TILE):
        x = slice(a, min(a + TILE, firsts))
        for b in range(a if alone else firsts, n, TILE):
            y = slice(b, min(b + TILE, n))
            linked = linked_tile(unit[x], unit[y], single[x], single[y], threshold)
            if several:
                linked &= group[x][:, None] == group[y][None, :]
            if alone and a == b:
                np.fill_diagonal(linked, False)
            weights = linked.astype(np.float64)
            links[x] += weights @ copies[y]
            if not (alone and a == b):
                links[y] += copies[x] @ weights
    at = np.flatnonzero(links)
    return pa.table({"class_id": ids[at], "links": links[at].astype(np.int64)})


def link_counts(vectors: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """class_id, links: for each pair of blocks of a group, its linked classes."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    members = groups.join(sizes, "component").join(vectors.select("class_id", "dim", "embedding", "copies"), "class_id")
    ceil = lambda a, b: F.call_function("div", a - 1, b) + 1
    most = F.greatest(F.call_function("div", F.lit(MOST), F.col("dim")), F.lit(LEAST))
    blocks = F.greatest(F.least(ceil(F.col("_size"), F.lit(LEAST)), F.lit(FEW)), ceil(F.col("_size"), most))
    small = F.col("_size") <= LEAST
    bins = groups.count() // BIN + 1
    members = members.withColumn("_blocks", blocks.cast("long")).withColumn("_own", F.pmod(F.xxhash64("class_id"), F.col("_blocks")))
    each = members.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    pairs = each.select(
        F.when(~small, F.col("component")).alias("_large"), F.when(small, F.pmod(F.xxhash64("component"), F.lit(bins))).alias("_bin"),
        F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
        (F.col("_own") > F.col("_other")).cast("int").alias("_side"), "component", "dim", "class_id", "embedding", "copies",
    )

    def linked(rows: pa.Table) -> pa.Table:
        return block_links(rows, threshold)

    return pairs.groupBy("dim", "_large", "_bin", "_i", "_j").applyInArrow(linked, "class_id long, links long")


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, passes: int = PASSES, bits: int = BITS, seed: int = 3
) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero, or holds null or non-finite components,
    or has no label, is linked with nothing, and so are vectors of different
    length. Equal rows are linked with each other. A class goes by its smallest
    vec_id; vec_ids are taken to be unique but for repeated rows, and a null one
    has no component but through others. Labels may be of any type that Spark can
    hash, and are equal when their 64-bit hashes are. Links are those of windows and
    within groups: one between two groups that no pass held side by side is missed,
    which is rare, as the last round must meet none. Other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(embeddings.sparkSession, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    rows = embeddings.select("vec_id", F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"), "embedding")
    a, b = two_hashes(F.col("label"), F.col("embedding"))
    known = rows.where(F.coalesce(good, F.lit(False))).select("vec_id", "label", "embedding", a.alias("_h1"), b.alias("_h2"))
    classes = known.groupBy("_h1", "_h2").agg(
        F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding"),
    )
    classes = scratch.table(classes.withColumn("dim", F.size("embedding")), "classes")
    vectors = classes.where("class_id is not null")
    groups = groups_of(vectors, scratch, threshold, passes, bits, window, seed)
    counts = link_counts(vectors, groups, threshold).groupBy("class_id").agg(F.sum("links").alias("links"))
    result = classes.select("_h1", "_h2", "class_id", "copies").join(groups, "class_id", "left").join(counts, "class_id", "left")
    result = scratch.table(result, "result").select(
        "_h1", "_h2",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class_id").alias("_component"),
    )
    matched = rows.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_h1", F.when(F.col("_good"), a)).withColumn("_h2", F.when(F.col("_good"), b))
    joined = matched.select("vec_id", "_h1", "_h2").join(result, ["_h1", "_h2"], "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def op3_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(configure(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
