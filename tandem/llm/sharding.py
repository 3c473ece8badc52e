"""Sharding: minimax contiguous partition of atomic groups, native.

Rows with equal texts form one atomic group. Groups are put in a fixed order (by the MD5 of their text), and that order
is cut into contiguous shards so that the largest shard is as small as any contiguous cut can make it. The smallest
feasible capacity is found by binary search, where a capacity is checked greedily: fill a shard up to the capacity, then
start the next one.

The search never needs the groups themselves on the driver. It works on totals of hash cells. A first pass counts 4,096
cells; the greedy check, once with cells taken as indivisible and once as divisible, bounds the capacity from above and
below and with it the few cells that a cut can fall into. Only those are split 256 ways in the next pass, until every
cell that a cut can fall into holds a single group, so that the result is the exact optimum. Groups larger than an even
share get shards of their own, which no partition can better, and the rest share what remains.

Null texts count as empty texts (size 8, CRC 0). Repeated rows are rows of their own and stay with their group. An empty
table gives an empty result. Rows are numbered in a shard by id hash cells, so that no task holds a whole shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import save

#: Groups above 1 / LARGE of all bytes are listed one by one; there are fewer than LARGE of them.
LARGE = 4096
#: Cells of one shard in which slots are counted.
SLOT_CELLS = 256


@dataclass
class Cell:
    """A stretch of the order: all groups whose key starts with a prefix."""

    prefix: str
    size: int
    single: bool


def _sums(cells: list[Cell]) -> list[int]:
    return list(accumulate((c.size for c in cells), initial=0))


def fill(cells: list[Cell], sums: list[int], capacity: int, shards: int, whole: bool) -> tuple[list[int], bool]:
    """Greedy check of a capacity: the cell that each shard ends before (or in), and whether all cells found room.

    whole: a shard takes cells whole; otherwise a cell of several groups can be cut anywhere, one of a single group not.
    """
    start, ends = 0, []
    for _ in range(shards):
        to = bisect_right(sums, start + capacity) - 1
        inside = not whole and to < len(cells) and not cells[to].single
        start = start + capacity if inside else sums[to]
        ends.append(to)
    return ends, start >= sums[-1]


def smallest_capacity(cells: list[Cell], shards: int, whole: bool) -> int:
    """Binary search for the least capacity with which the cells fit in the shards."""
    sums = _sums(cells)
    low, high = -(-sums[-1] // shards), max(sums[-1], 1)
    while low < high:
        middle = (low + high) // 2
        if fill(cells, sums, middle, shards, whole)[1]:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(cells: list[Cell], sums: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts that keep to the capacity and, within it, stand as near to equal shares as they can (greedy cuts leave the last shard short)."""
    greedy = fill(cells, sums, capacity, shards, True)[0][:-1]
    need, at = [], sums[-1]
    for _ in range(shards - 1):  # from the right: the least that must lie before each cut
        at = sums[bisect_left(sums, at - capacity)]
        need.append(at)
    cuts, start = [], 0
    for j, least in enumerate(reversed(need), 1):
        ideal = bisect_left(sums, sums[-1] * j // shards)
        if ideal and 2 * (sums[-1] * j // shards) < sums[ideal] + sums[ideal - 1]:
            ideal -= 1
        to = max(min(ideal, bisect_right(sums, start + capacity) - 1), min(bisect_left(sums, least), len(cells)))
        cuts.append(to)
        start = sums[to]
    edges = [0, *(sums[c] for c in cuts), sums[-1]]
    return cuts if all(0 <= b - a <= capacity for a, b in zip(edges, edges[1:])) else greedy


def contiguous_cuts(groups: DataFrame, shards: int, total: int) -> tuple[list[str], list[str]]:
    """Cuts a table of groups (key, size, large): keys with which the second and later shards begin, and oversized groups.

    At most LARGE groups and 256 cells for each cell that a cut can fall into come to the driver at a time.
    """
    large = [Cell(r.key, r.size, True) for r in groups.where("large").select("key", "size").collect()]
    own: list[str] = []
    rest = total
    for c in sorted(large, key=lambda c: (-c.size, c.prefix)):
        left = shards - len(own)
        if left == 1 or c.size * left < rest:
            break
        own.append(c.prefix)
        rest -= c.size
    k, width = shards - len(own), 4
    small = groups.where("not large")
    cells = [c for c in large if c.prefix not in set(own)] + _totals(small, width)
    while True:
        cells.sort(key=lambda c: c.prefix)
        sums = _sums(cells)
        low, high = smallest_capacity(cells, k, False), smallest_capacity(cells, k, True)
        spans = zip(fill(cells, sums, low, k, True)[0], fill(cells, sums, high, k, False)[0], strict=True)
        split = {cells[i].prefix for a, b in spans for i in range(a, min(b + 1, len(cells))) if not cells[i].single}
        if not split:
            return [cells[i].prefix for i in even_cuts(cells, sums, high, k) if i < len(cells)], own
        by_width: dict[int, list] = {}
        for p in split:
            by_width.setdefault(len(p), []).append((p,))
        cells = [c for c in cells if c.prefix not in split]
        for width, found in by_width.items():
            wanted = F.broadcast(groups.sparkSession.createDataFrame(found, "prefix string"))
            cells += _totals(small.join(wanted, F.substring("key", 1, width) == F.col("prefix"), "left_semi"), width + 2)


def _totals(groups: DataFrame, width: int) -> list[Cell]:
    rows = groups.groupBy(F.substring("key", 1, width).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return [Cell(r.prefix, r["size"], r.n == 1) for r in rows]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of the shards, near equal in bytes; rows with equal texts stay together.

    Returns id, size, text_crc32, shard and slot (gapless from 0 in each shard).
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = save(docs.select(F.col(id_col).alias("_id"), (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"), F.md5(data).alias("md5")), "shard-rows")
    sizes = rows.groupBy("md5").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    is_large = F.col("size") * LARGE > total
    key = F.concat(F.substring("md5", 1, 3), F.when(F.col("large"), "0").otherwise("1"), F.substring("md5", 4, 29))
    groups = save(sizes.withColumn("large", is_large).withColumn("key", key), "shard-groups")
    starts, own = contiguous_cuts(groups, shards, total) if total else ([], [])
    listed = groups.where("large").select("md5", "large")  # fewer than LARGE rows
    number = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("key"))) if starts else F.lit(0)
    for i, p in enumerate(own):
        number = F.when(F.col("key") == p, len(starts) + 1 + i).otherwise(number)
    keyed = rows.join(F.broadcast(listed), "md5", "left").withColumn("large", F.coalesce("large", F.lit(False))).withColumn("key", key)
    cell = F.pmod(F.xxhash64("_id", "text_crc32", "size"), F.lit(SLOT_CELLS))
    placed = keyed.select("_id", "size", "text_crc32", number.cast("int").alias("shard"), cell.alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # at most shards x SLOT_CELLS rows
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("_id", "text_crc32", "size"))
    numbered = placed.withColumn("within", within).join(F.broadcast(before), ["shard", "cell"])
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("within") - 1).alias("slot"))
