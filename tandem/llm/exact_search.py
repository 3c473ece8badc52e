"""Exact top-k search by inner product: a Voronoi kNN join.

Rows are grouped by the nearest of a bounded set of pivots, and the rows of a pivot by rings of their distance to it. Of each ring
its number of rows, its least and largest distance to the pivot and its largest length are kept.

1. A query is solved against a part of the ring in which it lies itself. Its k-th best score there bounds the one over all rows from
   below.
2. The inner product of a query q with a row x of pivot p is at most q.p + |q| d(x, p), and at most half of |q|^2 + |x|^2 less the
   square of the gap between d(q, p) and the ring. A ring whose bounds stay under the query's own cannot matter.
3. Queries are grouped by coarser pivots. A ring is replicated to the groups of which a query needs it, and no others; a query
   meets there the rings that it needs. Rings, and groups of queries, of many rows are split into parts of bounded size.

Where no bound prunes, as with vectors that lie in all directions alike, every ring goes to every group: n rows meet q queries
in n q / (BLOCK QUERIES) blocks, and the result is exact all the same.

Components are floor(1024 * x); sums of products are exact integers. Vectors that are null or hold null or non-finite
components take no part; shorter vectors count as filled up with zeros. Rows of one id are each candidates, and none is
a candidate of the query of that id; of repeated query rows one asks. Null ids take no part. Fewer than k candidates
give all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import save
from .vectors import BLOCK, QUERIES, asking, classes, over_packed, pack, ranked, solved, valid

SCALE, KIND = 1024, "<f8"
#: Most pivots, and rings of a pivot: what the driver holds of the table is at most PIVOTS x RINGS summaries.
PIVOTS, RINGS = 4096, 16


def _pivots(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """As many as the root of the number of rows, from 8 to PIVOTS: those of the smallest hash, without repeats."""
    wanted = min(PIVOTS, max(8, math.isqrt(n)))
    found = rows.orderBy(F.xxhash64("_id", "_n"), "_n").limit(wanted).collect()
    return np.unique(np.frombuffer(b"".join(bytes(r["_x"]) for r in found), KIND).reshape(-1, dim), axis=0) if found else np.zeros((1, dim))


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """The inner products of a query with rows, negated; most: the largest component of a row."""
    if np.abs(q).max(initial=1) * max(most, 1) * len(q) < 2**53:
        return -(x @ q).astype(np.int64)
    return -(x.astype(np.int64) @ q.astype(np.int64))


def search(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query row; is_query: a condition on the id."""
    best = solved(*join(rows, is_query, k, id_col, vector_col), KIND, k, products, "int64")
    return ranked(best, k).select("query_id", "rank", "vec_id", (-F.col("_s")).alias("score"))


def join(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, list[str], int]:
    """The candidates and queries of all blocks that bounds leave, their keys, and the number of components."""
    found = valid(rows, vector_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.transform("_v", lambda x: F.floor(x * SCALE).cast("double")).alias("_v"))
    dim = max(found.agg(F.max(F.size("_v"))).first()[0] or 0, 1)
    found = save(pack(found, dim, KIND), "search-rows")
    once = save(classes(found, k), "search-classes")
    pivots = _pivots(once, once.count(), dim)
    norms = (pivots**2).sum(1)

    def nearest(x: np.ndarray, _):
        d = (x**2).sum(1)[:, None] + norms - 2 * x @ pivots.T
        cell = d.argmin(1)
        return None, [pa.array(cell, pa.int64()), pa.array(np.sqrt(((x - pivots[cell]) ** 2).sum(1))), pa.array(np.sqrt((x**2).sum(1)))]

    placed = save(over_packed(once, ["_n", "_id", "copies"], dim, KIND, "cell long, far double, size double", nearest), "search-cells")
    steps = [i / RINGS for i in range(1, RINGS)]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", steps, 1000).alias("edges")).collect()  # at most PIVOTS rows
    count = {r.cell: min(RINGS, -(-r.n // BLOCK)) for r in cells}
    edges = {r.cell: np.array([r.edges[i * RINGS // count[r.cell] - 1] for i in range(1, count[r.cell])], float) for r in cells}
    spark = rows.sparkSession
    table = spark.createDataFrame([(c, e.tolist()) for c, e in edges.items()], "cell long, edges array<double>")
    ring = F.size(F.filter("edges", lambda e: F.col("far") > e))
    placed = save(placed.join(F.broadcast(table), "cell").select("_n", "_id", "copies", "_x", "far", "size", (F.col("cell") * RINGS + ring).alias("ring")), "search-rings")
    rings = placed.groupBy("ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("size").alias("size")).orderBy("ring").collect()
    number, low, high, size = (np.array([r[c] for r in rings], t) for c, t in (("ring", int), ("low", float), ("high", float), ("size", float)))
    parts = F.broadcast(spark.createDataFrame([(r.ring, -(-r.n // BLOCK)) for r in rings], "ring long, parts long"))
    placed = placed.join(parts, "ring").select("ring", "parts", F.pmod(F.xxhash64("_n"), "parts").alias("part"), "_n", "_id", "copies", "_x")
    asked = save(asking(found, is_query), "search-asked")
    groups = max(1, min(len(pivots), -(-asked.count() // QUERIES)))

    def home(q: np.ndarray, _):
        d = (q**2).sum(1)[:, None] + norms - 2 * q @ pivots.T
        cell = d.argmin(1)
        far = np.sqrt(np.maximum(d[np.arange(len(q)), cell], 0))
        spot = [int(c * RINGS + (f > edges.get(int(c), np.zeros(0))).sum()) for c, f in zip(cell, far)]
        spot = number[np.clip(np.searchsorted(number, spot), 0, max(len(number) - 1, 0))] if len(number) else np.zeros(len(q), int)
        return None, [pa.array(spot, pa.int64()), pa.array(d[:, :groups].argmin(1), pa.int64())]

    asked = save(over_packed(asked, ["query"], dim, KIND, "ring long, team long", home), "search-homes")
    bucket, zero = F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long")
    turns = F.broadcast(spark.createDataFrame([(r.ring, -(-r.n // QUERIES)) for r in asked.groupBy("ring").agg(F.count("*").alias("n")).collect()], "ring long, turns long"))  # at most PIVOTS x RINGS rows
    first = asked.join(turns, "ring").join(parts, "ring").select("ring", F.pmod(F.xxhash64("query"), "parts").alias("part"), F.pmod(F.xxhash64("query"), "turns").alias("turn"), bucket, "query", "_x")
    near = placed.join(turns, "ring").select("ring", "part", F.explode(F.sequence(zero, F.col("turns") - 1)).alias("turn"), bucket, "_n", "_id", "copies", "_x")
    tops = solved(near, first, ["ring", "part", "turn"], dim, KIND, k, products, "int64")
    bound = tops.groupBy("query_id").agg(F.max("_s").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("query"), (-F.col("worst")).alias("least"))
    pivot = number // RINGS

    def needed(q: np.ndarray, part: pa.RecordBatch):
        least = part.column(2).cast(pa.float64()).fill_null(-math.inf).to_numpy(zero_copy_only=False)
        length = np.sqrt((q**2).sum(1))
        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + norms - 2 * q @ pivots.T, 0))[:, pivot]
        gap = np.maximum(np.maximum(d - high, low - d), 0)
        most = np.minimum((q @ pivots.T)[:, pivot] + length[:, None] * high, (length[:, None] ** 2 + size**2 - gap**2) / 2)
        row, which = np.nonzero(most * (1 + 1e-9) + 1 + 1e-6 * np.abs(most) >= least[:, None])
        return row, [pa.array(number[which] if len(number) else which, pa.int64())]

    wanted = over_packed(asked.join(bound, "query", "left"), ["query", "team", "least"], dim, KIND, "ring long", needed, step=64)
    team = asked.groupBy("team").agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    wanted = save(wanted.join(F.broadcast(team), "team").select("ring", "team", F.pmod(F.xxhash64("query"), "turns").alias("turn"), "query", "_x"), "search-wanted")
    pairs = wanted.select("ring", F.col("team").alias("_team"), F.col("turn").alias("_turn")).distinct()
    candidates = placed.join(pairs, "ring").select("ring", F.col("_team").alias("team"), F.col("_turn").alias("turn"), "part", bucket, "_n", "_id", "copies", "_x")
    queries = wanted.join(parts, "ring").select("ring", "team", "turn", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), bucket, "query", "_x")
    return candidates, queries, ["ring", "team", "turn", "part"], dim
