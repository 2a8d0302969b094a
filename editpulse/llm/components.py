"""Connected components of a graph too large for one machine.

In a round, each task first joins what its own edges connect and leaves one edge
per node. Tasks get edges up to a fixed number, so a small graph is whole in one
and is done; a larger one is done as soon as the tasks' trees touch nowhere. Else
every node follows the smallest of its neighbours and itself by
hash: both ends of each edge are replaced by theirs, and what falls together
is gone. Nodes that nobody follows drop out, so the graph shrinks fast; small
ones are done after the first step. At the end the steps are composed. Every
round is a written table, so a lost executor costs a round at most, and no task
holds more than a bounded part of its edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from editpulse.llm.common import Scratch

EDGE = "node long, parent long"
#: A task gives out what it has and starts anew beyond so many nodes.
MOST_NODES = 1_000_000
#: So many edges go to one task.
TASK_EDGES = 250_000


def roots(a: Iterable[int], b: Iterable[int], parent: dict[int, int] | None = None) -> dict[int, int]:
    """node -> smallest node of its component, for the nodes of the edges; the smaller one becomes the root."""
    parent = {} if parent is None else parent

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a, b):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in parent:
        find(x)
    return parent


def forest(parent: dict[int, int]) -> pa.RecordBatch:
    pairs = [(x, p) for x, p in parent.items() if x != p]
    nodes, parents = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parents, pa.int64())], ["node", "parent"])


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for batch in batches:  # one entry per node, however many edges come
        roots(batch.column(0).to_pylist(), batch.column(1).to_pylist(), parent)
        if len(parent) > MOST_NODES:
            yield forest(parent)
            parent = {}
    yield forest(parent)


def trees_apart(links: DataFrame) -> bool:
    """Whether every node has one parent, which has none: then the tasks have found whole components."""
    nodes = links.select("node").unionByName(links.select(F.col("parent").alias("node")).distinct())
    return nodes.groupBy("node").count().where("count > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Edges (two long columns) -> (node, parent): the smallest node of the component, for all nodes but the smallest."""
    a, b = edges.columns
    links = edges.select(F.col(a).alias("node"), F.col(b).alias("parent")).distinct()
    steps: list[DataFrame] = []
    while True:
        k = len(steps)
        links = scratch.table(links, f"{name}-edges-{k}")
        links = links.coalesce(links.count() // TASK_EDGES + 1)
        links = scratch.table(links.mapInArrow(contract, EDGE), f"{name}-links-{k}")
        if trees_apart(links):
            steps.append(links)
            break
        both = links.unionByName(links.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
        # The nearest by a new hash each round, its own among them: chains in the order of ids would be followed one step a round.
        near = both.groupBy("node").agg(F.min(F.struct(F.xxhash64("parent", F.lit(k)).alias("h"), "parent")).alias("n"))
        own = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("parent"))
        least = near.where(F.col("n") < own).select("node", F.col("n.parent").alias("parent"))
        least = scratch.table(least, f"{name}-step-{k}")
        steps.append(least)
        from_a = least.select("node", F.col("parent").alias("a"))
        from_b = least.select(F.col("node").alias("parent"), F.col("parent").alias("b"))
        moved = links.join(from_a, "node", "left").join(from_b, "parent", "left")
        moved = moved.select(F.coalesce("a", "node").alias("node"), F.coalesce("b", "parent").alias("parent")).where("node != parent")
        links = moved.distinct()
    found = steps[0]
    for step in steps[1:]:
        up = step.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        found = found.join(up, "parent", "left").select("node", F.coalesce("top", "parent").alias("parent")).unionByName(step)
    # Ends are ends by hash; components go by their smallest node.
    found = scratch.table(found.distinct().withColumnRenamed("parent", "end"), f"{name}-found")
    ends = found.groupBy("end").agg(F.min("node").alias("low")).select("end", F.least("low", "end").alias("parent"))
    ends = scratch.table(ends, f"{name}-ends")
    # An end may have moved in an early round and come back, so it can be in both.
    nodes = found.join(ends, "end").select("node", "parent").unionByName(ends.withColumnRenamed("end", "node"))
    return scratch.table(nodes.where("node != parent").distinct(), f"{name}-all")
