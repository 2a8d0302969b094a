"""A keyed sink on files: all rows of a key in order, without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .files import write_batch


def write_keyed(rows: DataFrame, path: str, batch_id: int, order: Sequence[str], key: str = "key") -> None:
    """Write a micro-batch with a ``sequence`` that rises within each key by ``order``.

    Tasks hold ranges of (hash of the key, key, order). A range may begin within a
    key, so a hot key is split by its order, and the sequence goes on in the next
    task. Across micro-batches the order is that of (batch_id, sequence).
    """
    place = ["_hash", key, *order]
    placed = rows.withColumn("_hash", F.xxhash64(key)).repartitionByRange(*place).sortWithinPartitions(*place)
    write_batch(placed.drop("_hash").withColumn("sequence", F.monotonically_increasing_id()), path, batch_id)

