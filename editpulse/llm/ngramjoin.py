"""Similarity self-join on word n-grams (operator 5).

Texts become sets of 64-bit hashes of their distinct n-grams; equal sets are one
class. A class's n-grams are put in one global order, rare first: by a sketch of
how many documents hold them, then by hash. Two sets of Jaccard similarity t or
more share an n-gram among the first |x| - ceil(t |x|) + 1 of each, so classes
are joined on those prefixes. The length filter and the positional filter drop
pairs while they are made, the suffix filter works when the sets are at hand, and a
pair is verified once, on the whole sets.

Large groups of near copies would give all pairs many times over. So n-grams that
the same classes have are joined as one, and the join has rounds. In the first
ones each class is verified against one partner, the one it shares most prefix
n-grams with among some of a random order, and what links is one group from then
on. The last rounds verify, once, every pair of classes that still lie in different
groups, the likeliest of each class first, until none is left. So the components are
those of all links. Links are counted afterwards, within the groups: there, all pairs
of sets are compared, in pairs of blocks of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from editpulse.llm.common import NO_ID, Scratch, documents, partitions, two_hashes, whole
from editpulse.llm.components import components

WORDS = 5
#: The similarity as a fraction; all bounds are computed in integers.
NUMERATOR, DENOMINATOR = 75, 100
STAR_ROUNDS = 4
#: In star rounds, a pair is tried if it shares at least one in so many of its n-grams; the last round tries all that the filters leave.
STAR_SHARE = 20
#: How far the cuts of the bands move from round to round.
GOLDEN = 0.618
#: The last rounds try so many pairs of each class, then MORE_EACH times as many, until none is left.
FIRST_EACH, MORE_EACH = 8, 16
#: Pairs of one class verified in one place.
HUB = 512
#: A block of a group has about so many classes and n-grams at most; so many n-grams are compared at a time.
BLOCK, BLOCK_GRAMS, CHUNK = 512, 1 << 19, 4096
#: The sketch has a fixed size at any size of the corpus: 2**23 counters, in 512 slices; in the end a byte each, on a log scale.
SKETCH_BITS, SLICE_BITS = 23, 14
STEPS = 12
#: A set's signature has 64 times so many bits; an n-gram sets one.
SIGNED = 16
#: A pair is not made again where one of so many runs before it has made it.
RUNS_BEFORE = 64
#: Texts grow several times over in a worker, and several workers share an executor.
BATCH_BYTES = "4m"
#: Broadcast up to so many rows of 24 bytes; beyond, shuffle.
SMALL = 500_000
MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; of all words, if they are fewer."""
    words = raw.lower().split()  # on bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total += hashes[i : len(words) - width + 1 + i] * MULTIPLIERS[i]
    return np.unique(mixed(total))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def class_of(grams: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(grams.tobytes()))


def signatures(sets: list[np.ndarray]) -> pa.Array:
    """For each set, which of the low bits of n-grams occur in it; null for an empty one."""
    bits = np.zeros((len(sets), 64 * SIGNED), bool)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits[owner, (np.concatenate(sets) % np.uint64(64 * SIGNED)).astype(np.int64) if sets else owner] = True
    words = np.packbits(bits, axis=1).view(np.int64).ravel()
    lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SIGNED, pa.array(words))
    return pa.compute.if_else(pa.array([len(s) > 0 for s in sets], pa.bool_()), lists, pa.scalar(None, lists.type))


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def packed_slice(counts: np.ndarray) -> bytes:
    """A byte a counter where that is enough."""
    return zlib.compress((counts.astype(np.uint8) if counts.max() < 256 else counts).tobytes(), 1)


def unpacked_slice(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, np.uint8 if len(raw) == 1 << SLICE_BITS else np.uint32).astype(np.int64)


SIZED = "doc_id long, t1 long, t2 long, n_shingles long, class long, signature array<long>, slice int, counts binary"


def measure(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per document; behind them the task's part of the sketch, in slices."""
    names = ["doc_id", "t1", "t2", "n_shingles", "class", "signature", "slice", "counts"]
    sketch, shift = np.zeros(1 << SKETCH_BITS, np.uint32), np.uint64(64 - SKETCH_BITS)
    for batch in batches:
        sets = [shingles(t, n) for t in raw_texts(batch)]
        if sets:
            np.add.at(sketch, (np.concatenate(sets) >> shift).astype(np.int64), 1)
        nothing = len(sets)
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in names[:3]), pa.array([len(g) for g in sets], pa.int64()),
            pa.array([class_of(g) if len(g) else None for g in sets], pa.int64()), signatures(sets),
            pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary()),
        ], names)
    slices = sketch.reshape(-1, 1 << SLICE_BITS)
    used = np.flatnonzero(slices.any(axis=1))
    yield pa.RecordBatch.from_arrays([
        *[pa.nulls(len(used), pa.int64())] * 5, pa.nulls(len(used), pa.list_(pa.int64())),
        pa.array(used, pa.int32()), pa.array([packed_slice(slices[i]) for i in used], pa.binary()),
    ], names)


def add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per slice, as bytes with STEPS steps to a doubling; no more than the sums is held."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            part = unpacked_slice(packed)
            sums[k] = sums[k] + part if k in sums else part
    yield pa.RecordBatch.from_arrays([
        pa.array(list(sums), pa.int32()),
        pa.array([np.minimum(STEPS * np.log2(s + 1), 255).astype(np.uint8).tobytes() for s in sums.values()], pa.binary()),
    ], ["slice", "counts"])


def sketch_of(parts: DataFrame) -> np.ndarray:
    """The whole sketch; its size is fixed, so it may come to the driver."""
    slices = 1 << (SKETCH_BITS - SLICE_BITS)
    sums = parts.select("slice", "counts").repartition(slices, "slice").mapInArrow(add_slices, "slice int, counts binary")
    whole_sketch = np.zeros((slices, 1 << SLICE_BITS), np.uint8)
    for row in sums.collect():
        whole_sketch[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    return whole_sketch.ravel()


def least_overlap(a, b):
    """The smallest common count of sets of such sizes that are similar enough."""
    p, q = NUMERATOR, NUMERATOR + DENOMINATOR
    return -(-(p * (a + b)) // q)


def prefix_length(size: int) -> int:
    return size + (-NUMERATOR * size) // DENOMINATOR + 1


def entries(batches: Iterator[pa.RecordBatch], n: int, sketch) -> Iterator[pa.RecordBatch]:
    """gram, class, size, place in the order: the prefix of each class, once per task."""
    counts, shift = sketch.value, np.uint64(64 - SKETCH_BITS)
    seen: set[int] = set()
    for batch in batches:
        grams, classes, sizes, firsts = [], [], [], []
        for text in raw_texts(batch):
            own = shingles(text, n)
            if not len(own) or (name := class_of(own)) in seen:
                continue
            seen.add(name)
            first = prefix_length(len(own))
            order = np.argsort(counts[(own >> shift).astype(np.int64)], kind="stable")[:first]  # ties stay in the order of hashes
            grams.append(own[order])
            classes.append(name)
            sizes.append(len(own))
            firsts.append(first)
        if grams:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), firsts)),
                pa.array(np.repeat(np.array(sizes, np.int32), firsts)), pa.array(np.concatenate([np.arange(f, dtype=np.int32) for f in firsts])),
            ], ["gram", "class", "size", "place"])


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, size and class, those whose gram stands in another class too; each once.

    The last row of a batch is looked at again with the next one.
    """
    names, types = ["gram", "class", "size", "place"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    last, given = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in names]
        if last is not None:
            columns = [np.concatenate([[x], c]) for x, c in zip(last, columns)]
        new = np.ones(len(columns[0]), bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
        columns = [c[new] for c in columns]
        same = columns[0][1:] == columns[0][:-1]
        out = np.zeros(len(columns[0]), bool)
        out[1:] |= same
        out[:-1] |= same
        known = bool(out[-1]) if len(out) > 1 else given
        if given:
            out[0] = False
        last, given = [c[-1] for c in columns], known
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[out], t) for c, t in zip(columns, types)], names)


def as_sets(batches: Iterator[pa.RecordBatch], n: int, names: tuple[str, ...] = ("x", "part", "role", "class")) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t, n) for t in raw_texts(batch)]
        right = pa.array([class_of(g) == name for g, name in zip(sets, batch.column("class").to_pylist())], pa.bool_())
        grams = pa.array([g.tobytes() for g in sets], pa.binary())
        # What is left out is another text under the same doc_id.
        yield pa.RecordBatch.from_arrays([c.filter(right) for c in (*(batch.column(c) for c in names), grams)], [*names, "grams"])


def suffix_bound(x: np.ndarray, y: np.ndarray, cells: int = 32) -> int:
    """No more elements can be common: sorted hashes are cut at equal places, and each cell holds at most the smaller count."""
    cuts = (np.arange(1, cells, dtype=np.uint64) * np.uint64(2**64 // cells)).astype(np.uint64)
    a = np.diff(np.searchsorted(x, cuts), prepend=0, append=len(x))
    b = np.diff(np.searchsorted(y, cuts), prepend=0, append=len(y))
    return int(np.minimum(a, b).sum())


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by x, part and role: a hub (role 0), then those to be compared with it (role 1)."""
    place, hub = None, None
    for batch in batches:
        linked = []
        columns = [batch.column(c).to_pylist() for c in ("x", "part", "role", "class", "grams")]
        for x, part, role, name, grams in zip(*columns):
            grams = np.frombuffer(grams, np.uint64)
            if role == 0:
                place, hub = (x, part), grams
            elif place == (x, part):
                need = least_overlap(len(hub), len(grams))
                if suffix_bound(hub, grams) >= need and len(np.intersect1d(hub, grams, assume_unique=True)) >= need:
                    linked.append((x, name))
        xs, ys = zip(*linked) if linked else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, scratch: Scratch, name: str, n: int) -> DataFrame:
    """Of the pairs (x, y), those similar enough, by whole sets made from the texts anew.

    A pair's y goes to where its x is. An x with many pairs is sent to several
    parts, each with at most about HUB of them.
    """
    spark = scratch.spark
    hubs = pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("parts"))
    dealt = scratch.table(pairs.join(hubs, "x").select("x", "y", F.pmod(F.xxhash64("y"), "parts").alias("part")), f"{name}-pairs")
    asked = dealt.select("x", "part", F.lit(1).alias("role"), F.col("y").alias("class"))
    asked = asked.unionByName(dealt.select("x", "part", F.lit(0).alias("role"), F.col("x").alias("class")).distinct())
    asked = scratch.table(asked.join(classes.select("class", "_id"), "class"), f"{name}-asked")
    asked = F.broadcast(asked) if asked.count() <= SMALL else asked
    rows = texts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "text").join(asked, "_id")
    sets = rows.select("x", "part", "role", "class", "text").mapInArrow(partial(as_sets, n=n), "x long, part long, role int, class long, grams binary")
    sets = sets.repartition(partitions(spark), "x", "part").sortWithinPartitions("x", "part", "role", "class")
    return scratch.table(sets.mapInArrow(verify, "x long, y long"), name)


def links_between(sets: list[np.ndarray], copies: np.ndarray, firsts: int) -> np.ndarray:
    """For each set the copies of those it is linked with: the first ones with the others, or, if all are first, all with all."""
    sizes, alone = np.array([len(s) for s in sets]), firsts == len(sets)
    x, y = slice(0, firsts), slice(0 if alone else firsts, len(sets))
    links, grams = np.zeros(len(sets), np.int64), np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], np.repeat(np.arange(len(sets)), sizes)[order]
    same = grams[1:] == grams[:-1]
    shared = np.append(same, False) | np.insert(same, 0, False)
    grams, owner = grams[shared], owner[shared]
    nth = np.cumsum(np.insert(grams[1:] != grams[:-1], 0, False)) if len(grams) else np.zeros(0, np.int64)
    common = np.zeros((len(sizes[x]), len(sizes[y])))
    for at in range(0, int(nth[-1]) + 1 if len(nth) else 0, CHUNK):
        a, b = np.searchsorted(nth, [at, at + CHUNK])
        held = np.zeros((int(nth[b - 1]) + 1 - at, len(sets)), np.float32)
        held[nth[a:b] - at, owner[a:b]] = 1
        common += held[:, x].T @ held[:, y]
    linked = common >= least_overlap(sizes[x][:, None], sizes[y][None, :])
    if alone:
        np.fill_diagonal(linked, False)
    else:
        links[y] = copies[x] @ linked
    links[x] = linked @ copies[y]
    return links


def count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, blocks i and j, side and class; a row for each class and pair of blocks where it has links."""
    names = ["class", "links"]
    place, held = None, []

    def found() -> pa.RecordBatch:
        classes, copies, sides, sets = zip(*held) if held else ((), (), (), ())
        firsts = sum(side == 0 for side in sides)
        # Without others there is something to compare only within one block.
        counts = links_between(list(sets), np.array(copies), firsts) if firsts and (firsts < len(sets) or place[1] == place[2]) else np.zeros(len(sets), np.int64)
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([classes[k] for k in at], pa.int64()), pa.array(counts[at], pa.int64())], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("group", "i", "j", "side", "class", "copies", "grams")]
        for group, i, j, side, name, copies, grams in zip(*columns):
            if place != (group, i, j):
                yield found()
                place, held = (group, i, j), []
            if not held or held[-1][0] != name:  # repeated rows bring a class more than once
                held.append((name, copies, side, np.frombuffer(grams, np.uint64)))
    yield found()


def link_counts(groups: DataFrame, texts: DataFrame, classes: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """class, links: the rows of other classes that a class is linked with; every link lies within a group."""
    members = groups.join(classes.select("class", "_id", "copies", "size"), "class")
    ceil = lambda a, b: F.call_function("div", a - 1, F.lit(b)) + 1
    blocks = F.greatest(ceil(F.count(F.lit(1)), BLOCK), ceil(F.sum("size"), BLOCK_GRAMS)).alias("blocks")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), blocks).where("n > 1").drop("n")
    asked = scratch.table(members.join(sizes, "group").select("_id", "class", "copies", "group", "blocks"), "counted-asked")
    asked = F.broadcast(asked) if asked.count() <= SMALL else asked
    names = ("class", "copies", "group", "blocks")
    # copies and blocks go along; the class, which as_sets checks, tells texts under one doc_id apart.
    rows = texts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "text").join(asked, "_id").select(*names, "text")
    kind = "class long, copies long, group long, blocks long, grams binary"
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    sets = rows.mapInArrow(partial(as_sets, n=n, names=names), kind).withColumn("own", own)
    each = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select(
        "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "class", "copies", "grams",
    )
    each = each.repartition(partitions(scratch.spark), "group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "class")
    counts = each.mapInArrow(count_links, "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))
    return scratch.table(counts, "counts")


def lengths_allow(a: str, b: str):
    small, large = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    return DENOMINATOR * small >= NUMERATOR * large


def within_prefixes(a: str, b: str, a_place: str, b_place: str):
    """Positional filter by the overlap that sets of such sizes need at least.

    The first n-gram that a pair has in common begins a run of both; if it stands
    behind ``size - overlap`` others of either set, too few are left.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    overlap = F.ceil(F.lit(NUMERATOR) * (x + y) / F.lit(NUMERATOR + DENOMINATOR))
    return (F.col(a_place) <= x - overlap) & (F.col(b_place) <= y - overlap)


def overlap_bound(a: str, b: str, a_size: str, b_size: str):
    """Exact bound of the overlap: a bit that only one set has stands for at least one n-gram that only it has."""
    def common(p: str, size: str, q: str):
        alone = (F.bit_count(F.get(p, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(q, F.lit(i))))) for i in range(SIGNED))
        return F.col(size).cast("long") - reduce(Column.__add__, alone)

    return F.least(common(a, a_size, b), common(b, b_size, a))


def signatures_allow(a: str, b: str, a_size: str, b_size: str):
    needed = NUMERATOR * (F.col(a_size).cast("long") + F.col(b_size))
    return (NUMERATOR + DENOMINATOR) * overlap_bound(a, b, a_size, b_size) >= needed


def runs_of(shared: DataFrame) -> DataFrame:
    """(gram, class, size, place) -> (run, class, size, weight, place): n-grams that the same classes have are one run.

    A passage or a family of copies brings many such n-grams; what they are worth
    is counted in ``weight``, and ``place`` is where the first of them, the same for all, stands. A run is named by the exclusive or of its classes' hashes.
    Should two runs ever get one name, classes meet that need not: no pair is lost.
    """
    a, b = two_hashes(F.col("class"))
    names = shared.groupBy("gram").agg(F.struct(F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"), F.count(F.lit(1)).alias("n")).alias("run"))
    names = names.select("gram", F.xxhash64("run.a", "run.b", "run.n").alias("run"))
    return shared.join(names, "gram").groupBy("run", "class", "size").agg(F.count(F.lit(1)).alias("weight"), F.min("place").alias("place"))


def star_pairs(runs: DataFrame, groups: DataFrame, tried: DataFrame | None, k: int) -> DataFrame:
    """For each class at most one pair that is worth verifying and was not tried.

    A run is cut into bands of similar size, and each band is put in a random
    order, new in round ``k``, as are the cuts. There, a class's partners are the
    first one and the one before it; of its partners, the one with which it shares
    most is taken, if that is enough. The order is the same in all runs, so that
    members of a family meet in many of them. The window holds two rows, not the run.
    """
    size = F.floor(F.log(F.col("size")) / F.log(F.lit(DENOMINATOR / NUMERATOR)) + F.lit(k * GOLDEN))
    run = Window.partitionBy("run", "band").orderBy(F.xxhash64("class", F.lit(k)), "class")
    row = F.struct("class", "size", "group")
    rows = runs.join(groups, "class").withColumn("band", size)
    seen = rows.select("class", "size", "group", "weight", F.first(row).over(run).alias("a"), F.lag(row).over(run).alias("b"))
    found = []
    for name in ("a", "b"):
        pair = seen.select(
            F.col(f"{name}.class").alias("x"), F.col("class").alias("y"), F.col(f"{name}.size").alias("x_size"), F.col("size").alias("y_size"), "weight"
        )
        found.append(pair.where((F.col(f"{name}.group") != F.col("group")) & lengths_allow("x_size", "y_size")))
    votes = found[0].unionByName(found[1]).groupBy("x", "y", "y_size").agg(F.sum("weight").alias("n"))
    likely = votes.where(STAR_SHARE * F.col("n") >= F.col("y_size"))
    likely = likely if tried is None else likely.join(tried, ["x", "y"], "left_anti")
    best = likely.groupBy("y").agg(F.max_by("x", F.struct("n", "x")).alias("x"))
    return best.select("x", "y")


def meetings(runs: DataFrame, groups: DataFrame, signed_classes: DataFrame) -> DataFrame:
    """x, y, n: the pairs that pass the filters and lie in different groups, where they meet first; ``n`` bounds the overlap.

    In each run, the classes outside the run's largest group meet all others; those
    inside it have nothing to find among themselves. The signatures drop most pairs
    of a family that are not similar while they are made. The order of n-grams is one
    for all classes, so the first run that two have in common is the same for both, and
    is where the positional filter holds; of a pair's other runs, those with a common one among the
    ``RUNS_BEFORE`` before it give nothing.
    """
    before = Window.partitionBy("class").orderBy("place", "run").rowsBetween(-RUNS_BEFORE, -1)
    rows = runs.withColumn("before", F.collect_list("run").over(before)).join(groups, "class")
    sizes = runs.join(groups, "class").groupBy("run", "group").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("run").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count(F.lit(1)).alias("groups"))
    rows = rows.join(mains.where("groups > 1").drop("groups"), "run").join(signed_classes, "class")

    def side(name: str, run: str, *more: str) -> DataFrame:
        known = {"class": name, "size": f"{name}_size", "group": f"{name}_group", "place": f"{name}_place", "signature": f"{name}_bits", "before": f"{name}_before"}
        return rows.select(F.col("run").alias(run), *(F.col(c).alias(of) for c, of in known.items()), *more)

    few, every = side("a", "run", "main").where("a_group != main").drop("main"), side("b", "of", "main")
    met = few.join(every, F.col("run") == F.col("of")).where(
        (F.col("a_group") != F.col("b_group")) & lengths_allow("a_size", "b_size")
        & within_prefixes("a_size", "b_size", "a_place", "b_place")
        & ((F.col("b_group") == F.col("main")) | (F.col("a") < F.col("b")))
        & signatures_allow("a_bits", "b_bits", "a_size", "b_size")
        & ~F.arrays_overlap("a_before", "b_before")
    )
    return met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), overlap_bound("a_bits", "b_bits", "a_size", "b_size").alias("n"))


def all_pairs(runs: DataFrame, groups: DataFrame, signed_classes: DataFrame) -> DataFrame:
    """Every pair that passes the filters and lies in different groups; each once."""
    return meetings(runs, groups, signed_classes).groupBy("x", "y").agg(F.max("n").alias("n"))


def with_swapped(tried: DataFrame | None, pairs: DataFrame) -> DataFrame:
    both = pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    return both if tried is None else tried.unionByName(both)


def regrouped(found: DataFrame, groups: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """class, group, with the groups that the links found connect as one."""
    ends = found.join(groups.select(F.col("class").alias("x"), F.col("group").alias("a")), "x")
    ends = ends.join(groups.select(F.col("class").alias("y"), F.col("group").alias("b")), "y").where("a != b")
    tops = components(ends.select("a", "b"), scratch, name).select(F.col("node").alias("group"), F.col("parent").alias("top"))
    joined = groups.join(tops, "group", "left").select("class", F.coalesce("top", "group").alias("group"))
    return scratch.table(joined, f"{name}-groups")


def similar_documents(docs: DataFrame, n: int = WORDS, star_rounds: int = STAR_ROUNDS, links: bool = True) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n_shingles, component_id, and if asked for class, n_links, for every row of ``docs``.

    Rows with equal sets have one ``class`` (null without n-grams), and ``n_links``
    is the number of other rows that a row is linked with, those of its class
    among them. So the links are the pairs of classes, each with its rows.

    Null texts, empty ones and those without words have no n-grams and are
    linked with nothing. Rows with equal sets are linked; rows that share a
    doc_id are told apart by their texts. component_id is the smallest doc_id
    reachable (null only where no row of the component has one); a row that is
    linked with nothing has its own. Other columns are ignored; an empty table
    gives no rows. Equality of n-grams is that of 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    texts = docs.select("doc_id", whole().alias("text"))
    a, b = two_hashes(F.col("text"))
    measured = scratch.table(texts.select("doc_id", "text", a.alias("t1"), b.alias("t2")).mapInArrow(partial(measure, n=n), SIZED), "measured")
    sketch = spark.sparkContext.broadcast(sketch_of(measured.where("slice is not null")))
    known = measured.where("slice is null")
    rows = known.select("doc_id", "t1", "t2", "n_shingles", "class")
    classes = scratch.table(known.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("_id"),
        F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"),
        F.first("signature").alias("signature"),
    ), "classes")

    prefixes = texts.select("text").mapInArrow(partial(entries, n=n, sketch=sketch), "gram long, class long, size int, place int")
    prefixes = prefixes.repartition(partitions(spark), "gram").sortWithinPartitions("gram", "size", "class")
    shared = scratch.table(prefixes.mapInArrow(shared_only, "gram long, class long, size int, place int"), "shared")

    runs = scratch.table(runs_of(shared), "runs")
    scratch.drop("shared")
    sharing = scratch.table(runs.select("class").distinct(), "sharing")

    groups, tried = sharing.select("class", F.col("class").alias("group")), None
    for k in range(star_rounds):
        pairs = scratch.table(star_pairs(runs, groups, tried, k), f"star-{k}")
        tried = with_swapped(tried, pairs)
        found = verified(pairs, texts, classes, scratch, f"star-{k}-links", n)
        if found.isEmpty():
            break
        groups = regrouped(found, groups, scratch, f"round-{k}")
    # The pairs are made once; later rounds drop those that were tried or whose ends are in one group by then.
    left = all_pairs(runs, groups, classes.select("class", "signature"))
    left = scratch.table(left if tried is None else left.join(tried, ["x", "y"], "left_anti"), "left-0")
    scratch.drop("runs")
    each, k = FIRST_EACH, 0
    while not left.isEmpty():
        nth = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("n"), "x"))
        pairs = scratch.table(left.withColumn("nth", nth).where(F.col("nth") <= each).select("x", "y"), f"rest-{k}")
        found = verified(pairs, texts, classes, scratch, f"rest-{k}-links", n)
        groups = regrouped(found, groups, scratch, f"rest-{k}")
        ends = left.join(pairs, ["x", "y"], "left_anti")
        ends = ends.join(groups.select(F.col("class").alias("x"), F.col("group").alias("a")), "x")
        ends = ends.join(groups.select(F.col("class").alias("y"), F.col("group").alias("b")), "y").where("a != b")
        left = scratch.table(ends.select("x", "y", "n"), f"left-{k + 1}")
        scratch.drop(f"left-{k}", f"rest-{k}", f"rest-{k}-pairs", f"rest-{k}-asked", f"rest-{k}-links")
        each, k = each * MORE_EACH, k + 1
    scratch.drop(f"left-{k}")

    named = classes.join(groups, "class", "left").withColumn("group", F.coalesce("group", "class"))
    least = named.groupBy("group").agg(F.min("first_id").alias("least"))
    ids = named.join(least, "group").select("class", "least", "copies")
    if links:
        ids = ids.join(link_counts(groups, texts, classes, scratch, n), "class", "left")
        ids = ids.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).drop("links")
    joined = rows.join(scratch.table(ids, "ids"), "class", "left")
    counted = ["class", F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []
    return joined.select("doc_id", "t1", "t2", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), *counted)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir), links=False).select("doc_id", "n_shingles", "component_id")


def op5_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole join: components as op5_ngram_join has them, and the links."""
    return similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class", "n_links")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's, without repeated rows; all columns.

    Rows without doc_id stay where their component has no doc_id at all.
    """
    found = similar_documents(docs, links=False)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "t1", "t2")
    a, b = two_hashes(whole())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), a.alias("t1"), b.alias("t2"))
    left = rows.join(gone, ["id", "t1", "t2"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("id", "t1", "t2").orderBy(F.lit(1)))
    return left.withColumn("nth", nth).where("nth = 1").select("row.*")
