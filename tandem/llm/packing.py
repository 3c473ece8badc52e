"""Best-fit packing with Martello-Toth dominance reduction.

What is packed is only told by lengths, of which there are at most capacity, so the plan is made on the number of pieces
of each length, whatever the size of the corpus. The reduction fixes sets that dominate every other way of filling
a sequence with the longest piece left: a piece that nothing fits with; a piece and one that fills the sequence exactly;
a piece and the longest that fits, when no two others fit, or when two others that fit are together no longer than it.
The rest is packed best-fit in order of decreasing length, all pieces of a length at a time. The plan is a list of
patterns (pieces by length) with the number of sequences of each.

Pieces are then numbered within their length, by id hash cells whose number grows with the pieces of the length, so that
no task holds all of them, and looked up in the plan by length and number. Equal rows fall into one cell.

Null texts count as empty; an empty text is one piece that holds the end id only. Repeated rows are packed each. An
empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, over_texts
from .tables import save

#: The pieces of a length are numbered in cells: at least so many, and one more for every so many pieces.
CELLS, CELL = 32, 1 << 14

Pattern = tuple[tuple[int, int], ...]  # (length, pieces of that length), longest first


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixes dominating sets; returns the patterns with their number, and what is left."""
    left = {s: c for s, c in counts.items() if c}
    sizes = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            sizes.pop(bisect_left(sizes, s))

    def smallest(n: int, but: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n, left[s] - (s == but))
            if len(out) >= n:
                break
        return out[:n]

    for s in sorted(left, reverse=True):
        while left[s]:  # of a length that cannot be fixed all pieces are left to best fit
            room = capacity - s
            low = smallest(3, s)
            if not low or low[0] > room:
                fixed.append((((s, 1),), left[s]))
                take(s, left[s])
                continue
            at = bisect_left(sizes, room + 1) - 1
            if sizes[at] == s and left[s] < 2:
                at -= 1
            best = sizes[at]
            alone = len(low) < 2 or low[0] + low[1] > room
            dominates = best == room or alone or ((len(low) < 3 or sum(low) > room) and best >= _best_pair(sizes, left, s, room))
            if not dominates:
                break
            if best == s:
                n = left[s] // 2 if best == room or alone else 1
                fixed.append((((s, 2),), n))
                take(s, 2 * n)
            else:
                n = min(left[s], left[best]) if best == room or alone else 1
                fixed.append((((s, 1), (best, 1)), n))
                take(s, n)
                take(best, n)
    return fixed, {s: c for s, c in left.items() if c}


def _best_pair(sizes: list[int], left: dict[int, int], but: int, room: int) -> int:
    """The largest sum of two pieces that fits in the room (0 if none)."""
    best, j = 0, len(sizes) - 1
    for i, a in enumerate(sizes):
        if left[a] - (a == but) < 1:
            continue
        while j >= i and (a + sizes[j] > room or left[sizes[j]] - (sizes[j] == but) < 1 + (j == i)):
            j -= 1
        if j < i:
            break
        best = max(best, a + sizes[j])
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: all pieces of a length go at once to the fullest sequences that have room."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room <= 0:
            done.append((pattern, n))
            return
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((pattern, n))

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, pattern, n = capacity, (), -(-c // (capacity // s))
            each = room // s
            full = min(n, c // each)
            if full:
                put(room - each * s, (*pattern, (s, each)), full)
            c -= full * each
            if full < n:
                if 0 < c < each:
                    put(room - c * s, (*pattern, (s, c)), 1)
                    c, full = 0, full + 1
                if full < n:
                    put(room, pattern, n - full)
    return done + [x for group in open_.values() for x in group]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of lengths, each with the number of sequences that follow it."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def placements(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, each, sequence, offset): pieces numbered from .. to - 1 of a length go, each to a sequence, in turn."""
    used: Counter = Counter()
    rows, first = [], 0
    for pattern, n in patterns:
        offset = 0
        for s, each in pattern:
            rows.append((s, used[s], used[s] + n * each, each, first, offset))
            used[s] += n * each
            offset += s * each
        first += n
    return rows


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded texts, each with the end id, cut into pieces of the capacity; of a longer one the first piece takes the remainder."""

    def cut(texts):
        rows, found = [], []
        for row, text in enumerate(texts):
            ids = np.append(codec(path).encode(text), np.uint32(end_id)).astype("<u4")
            first = len(ids) % capacity or capacity
            edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                rows.append(row)
                found.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        k, start, length, crc = zip(*found) if found else ((), (), (), ())
        return rows, [pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]

    return over_texts(docs, [id_col], text_col, "piece int, start long, length long, ids_crc32 long", cut)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences: one row per piece, with its sequence_id and offset there."""
    spark = docs.sparkSession
    found = save(pieces(docs, capacity, end_id, path, id_col, text_col), "pack-pieces")
    totals = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    cells = spark.createDataFrame([(s, CELLS + n // CELL) for s, n in totals.items()], "length long, _cells long")
    found = found.join(F.broadcast(cells), "length").withColumn("_cell", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("_cells")))
    counts = found.groupBy("length", "_cell").agg(F.count("*").alias("n"))
    rows = placements(plan(totals, capacity))
    table = spark.createDataFrame(rows, "_length long, _from long, _to long, _each long, _sequence long, _offset long")
    before = counts.select("length", "_cell", (F.sum("n").over(Window.partitionBy("length").orderBy("_cell")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_cell").orderBy(id_col, "piece", "ids_crc32")) - 1
    number = found.withColumn("_within", within).join(before, ["length", "_cell"]).withColumn("_n", F.col("_before") + F.col("_within"))
    # The plan has one row for each length in each pattern: some 6,000 rows from 20 thousand to 20 million pieces.
    placed = number.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_to")))
    turn = F.col("_n") - F.col("_from")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(turn / F.col("_each"))).alias("sequence_id"), (F.col("_offset") + F.pmod(turn, F.col("_each")) * F.col("length")).alias("offset"),
    )
