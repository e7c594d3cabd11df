"""Filling containers of a fixed capacity (best-fit decreasing with a segment tree over remaining capacities).

Items are spread by a hash over groups of a bounded expected size, which are packed independently and in parallel; this
adds at most about one partly filled container per group. Within a group, items come in decreasing size; a segment tree
over remaining capacities (a leaf per capacity, holding how many containers are open with that much room) yields the
tightest open container in logarithmic time per item.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.plans.shipping import ship

#: Items per group; a group is packed by one task in about 100 bytes an item.
GROUP_ITEMS = 50_000


class OpenBins:
    """Open containers by remaining room; `take(size)` removes the tightest that has room for size, and returns it or None."""

    def __init__(self, capacity: int) -> None:
        self._size = 1 << capacity.bit_length()
        self._some = [0] * (2 * self._size)
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, number: int) -> None:
        self._bins[room].append(number)
        k = self._size + room
        while k:
            self._some[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        some, k = self._some, self._size + size
        if not some[k]:
            # Up to the first ancestor with an open container to the right, then down its leftmost path.
            while k > 1 and (k & 1 or not some[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self._size:
                k = 2 * k if some[2 * k] else 2 * k + 1
        room = k - self._size
        while k:
            some[k] -= 1
            k >>= 1
        return room, self._bins[room].pop()


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The container of each item, and how many there are; the sizes must come in decreasing order and fit the capacity."""
    free, placed, bins = OpenBins(capacity), [], 0
    for size in sizes:
        if (found := free.take(size)) is None:
            room, number, bins = capacity, bins, bins + 1
        else:
            room, number = found
        placed.append(number)
        if room > size:
            free.add(room - size, number)
    return placed, bins


def pieces(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(key, copy, piece, first, tokens): an item that fits is one piece; a larger one gives full pieces and a rest.

    Equal items (one key and one size, NULL keys among them) are counted and numbered as copies, so that every piece
    has a name of its own that does not depend on the order of rows. Items whose size is NULL, zero or negative are left out.
    """
    items = sizes.select(F.col(f"`{key}`").alias("k"), F.col(f"`{size}`").cast("long").alias("n")).filter("n > 0").groupBy("k", "n").agg(F.count(F.lit(1)).alias("copies"))
    copies = items.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    cut = copies.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
    first = F.col("piece").cast("long") * capacity
    return cut.select(F.col("k").alias(key), "copy", "piece", first.alias("first"), F.least(F.col("n") - first, F.lit(capacity)).cast("int").alias("tokens"))


def piece_count(sizes: DataFrame, capacity: int, size: str = "tokens") -> int:
    """How many pieces the items give."""
    n = F.col(f"`{size}`").cast("long")
    return sizes.select(F.coalesce(F.sum(F.when(n > 0, F.floor((n - 1) / capacity) + 1)), F.lit(0))).first()[0]


def pack(sizes: DataFrame, capacity: int, expected_pieces: int, key: str = "doc_id", size: str = "tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container_id, key, piece, first, tokens): every item in containers of at most `capacity`.

    Each item lies whole in one container, unless it alone is larger: then its pieces are full containers and a rest.
    expected_pieces sets the number of groups; a group is drawn by key, size, copy and piece, so neither a hot key nor a
    very large item makes one group large. Equal sizes are taken in order of key, copy and piece, so the result and the
    container ids are the same for any order of rows. Repeated keys are items of their own; NULL keys are packed like
    any other. Container ids are unique, not consecutive.
    """
    ship(sizes.sparkSession)
    groups = max(1, -(-expected_pieces // group_items))
    cut = pieces(sizes, capacity, key, size)
    kind = cut.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "k", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        placed, _ = best_fit(rows["tokens"].tolist(), capacity)
        return rows.assign(container_id=[int(rows["g"].iloc[0]) << 40 | c for c in placed])[["container_id", "k", "piece", "first", "tokens"]]

    group = F.pmod(F.xxhash64(key, "copy", "piece", "tokens", F.lit(7)), F.lit(groups)).alias("g")
    grouped = cut.select(F.col(key).alias("k"), "copy", "piece", "first", "tokens", group).groupBy("g")
    return grouped.applyInPandas(run, f"container_id bigint, k {kind}, piece int, first bigint, tokens int").withColumnRenamed("k", key)
