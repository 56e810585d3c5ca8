"""Filling containers of fixed capacity with items (problem 7).

Variable-capacity best fit. Items go, in groups of bounded size, through a
best-fit pass in decreasing size that knows several permitted sequence lengths:
an item is put into the open bin it fills best; where none fits, a bin of the
length is opened that the remaining items are expected to fill with the least
cost per stored token, and at the end every bin is cut down to the smallest
permitted length that holds its contents. Items larger than the capacity are
cut into full pieces and a rest; no other item is ever cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.session import Scratch

CAPACITY = 2048
#: Permitted sequence lengths; the largest is the container's capacity.
LENGTHS = (512, 1024, 2048)
#: Cost of one more container, in tokens; it favours few long bins over many short ones.
OPENING = 64
#: Items packed together in one group. A group leaves at most a few bins partly filled, so the loss is about one bin in thousands of items.
GROUP = 20_000


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """(bin number of each item, final length of each bin) for sizes of at most the largest length.

    Sizes of 0 or less are refused. Equal sizes are taken in the order given,
    so the result is a function of the list.
    """
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    if any(n <= 0 or n > top for n in sizes):
        raise ValueError("an item must have a size from 1 to the largest length")
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left = [0] * (top + 1)  # items not yet placed, by size
    for n in sizes:
        left[n] += 1
    present = sorted({n for n in sizes})  # sizes that still occur
    bin_of, used, room = [0] * len(sizes), [], []
    open_by_room: list[list[int]] = [[] for _ in range(top + 1)]
    rooms: list[int] = []  # rooms for which some bin is open, ascending

    def waste(gap: int) -> int:
        """What a greedy fill with the items still left would leave of a gap."""
        k = bisect_left(present, gap + 1) - 1
        while gap and k >= 0:
            n = present[k]
            gap -= n * min(left[n], gap // n)
            k = min(k, bisect_left(present, gap + 1)) - 1
        return gap

    for i in order:
        n = sizes[i]
        left[n] -= 1
        if not left[n]:
            present.pop(bisect_left(present, n))
        k = bisect_left(rooms, n)
        if k < len(rooms):
            gap = rooms[k]
            b = open_by_room[gap].pop()
            if not open_by_room[gap]:
                rooms.pop(k)
        else:
            # The least-cost length: expected waste and the opening cost per token of it.
            length = min((c for c in lengths if c >= n), key=lambda c: ((waste(c - n) + OPENING) / c, -c))
            b, gap = len(used), length
            used.append(0)
            room.append(length)
        bin_of[i] = b
        used[b] += n
        gap -= n
        if gap:
            if not open_by_room[gap]:
                insort(rooms, gap)
            open_by_room[gap].append(b)
    return bin_of, [lengths[bisect_left(lengths, u)] for u in used]


def pack(
    sizes: DataFrame, scratch: Scratch, id_col: str = "doc_id", size_col: str = "n_tokens",
    capacity: int = CAPACITY, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP,
) -> DataFrame:
    """Placement of every item: (id, piece, first_token, n_tokens, bin, bin_capacity).

    Items with null, zero or negative size take no room and no row. ``piece``
    counts from 0 and is 0 for items that are not cut. Rows with the same id
    are separate items of which each is placed. A bin belongs to one group;
    groups are drawn by hash, so neither a common source nor a common size
    makes one of them large, and their number follows the number of items.
    """
    if max(lengths) != capacity:
        raise ValueError("the largest permitted length is the capacity")
    kind = sizes.schema[id_col].dataType.simpleString()
    items = sizes.where(F.col(size_col) > 0).select(id_col, F.col(size_col).cast("bigint").alias("n_tokens"))
    items = scratch.save(items, "sizes")
    number = items.count()
    pieces = items.select(
        id_col,
        "n_tokens",
        F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {capacity}L)")).alias("piece"),
    ).select(
        id_col,
        "piece",
        (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"),
    )
    groups = max(1, -(-number // group))
    salted = pieces.withColumn("g", F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "piece", "n_tokens"], kind="stable")
        bins, final = best_fit(pdf["n_tokens"].tolist(), lengths)
        pdf["bin"] = [f"{g}-{b}" for g, b in zip(pdf["g"].tolist(), bins)]
        pdf["bin_capacity"] = [final[b] for b in bins]
        return pdf[[id_col, "piece", "first_token", "n_tokens", "bin", "bin_capacity"]]

    schema = f"`{id_col}` {kind}, piece bigint, first_token bigint, n_tokens bigint, bin string, bin_capacity bigint"
    return salted.groupBy("g").applyInPandas(place, schema)
