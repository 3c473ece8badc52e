"""Centroid clustering with Elkan's bounds.

Vectors become integers, and so do centroids (floors of means), so that all squared distances are exact. Each vector carries an upper
bound of the distance to its own centroid and a lower bound for each centroid. A distance is computed only where neither the lower bound nor
half the distance between the two centroids exceeds the upper bound. When centroids move, bounds give way by as much.

Bounds are rounded away from the distance they bound, and a distance is skipped only where a bound is strictly larger: a tie is
never skipped, and goes to the smaller number. So each assignment is the one that all distances would give; the distances that decide are integers.

A round is one pass: it reads the rows with their bounds, and writes them anew to the shared folder, from where sums by cluster are taken
(partial ones within each task, then over tasks). The driver sees k centroids and no rows.

Vectors of other lengths, null ones, and those with null or non-finite components are left out. Of fewer than k vectors each starts a
centroid; a null id counts as the text null in the order of hashes, and equal hashes go by the vector's bytes. Repeated rows are rows. An empty
table gives no rows. Components of 2**27 or more after scaling would give distances beyond a long, and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import save
from .vectors import matrix, packed, valid

SCALE = 256
LARGEST = 2**27
STATE = "_x binary, cluster int, upper double, lower binary, distance long"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to one centroid, or to one each."""
    d = x - c
    return (d * d).sum(-1)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row, ties to the smaller number: (own, upper, lower, how many distances were computed). lower changes in place."""
    k = len(centroids)
    between = np.array([np.sqrt(squared(centroids, c)) for c in centroids])
    half = _down(_down(between) / 2)
    np.fill_diagonal(half, np.inf)
    own, upper, computed = own.copy(), upper.copy(), 0
    open_rows = np.flatnonzero(~(upper < half.min(1)[own]))
    best = squared(x[open_rows], centroids[own[open_rows]])
    computed += len(open_rows)
    upper[open_rows] = _up(np.sqrt(best))
    lower[open_rows, own[open_rows]] = _down(np.sqrt(best))
    for c in range(k):
        mine = own[open_rows]
        ask = np.flatnonzero((mine != c) & ~(upper[open_rows] < lower[open_rows, c]) & ~(upper[open_rows] < half[mine, c]))
        rows = open_rows[ask]
        d = squared(x[rows], centroids[c])
        computed += len(rows)
        lower[rows, c] = _down(np.sqrt(d))
        nearer = (d < best[ask]) | ((d == best[ask]) & (c < own[rows]))
        won = rows[nearer]
        own[won], upper[won], best[ask[nearer]] = c, _up(np.sqrt(d[nearer])), d[nearer]
    return own, upper, lower, computed


def _moved(upper: np.ndarray, lower: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds once the centroids have moved."""
    step = _up(np.sqrt(squared(before, after).astype(float)))
    return _up(upper + step[own]), _down(lower - step)


def _floor32(x: np.ndarray) -> np.ndarray:
    """32-bit numbers that are not larger."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _round(state: DataFrame, before: np.ndarray, after: np.ndarray, dim: int, kind: str) -> DataFrame:
    """State after one assignment to the centroids after; the bounds of state are those of the centroids before."""
    schema = StructType([state.schema["_id"], *StructType.fromDDL(STATE).fields])
    k = len(after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                ids, raw, own, upper, lower = (batch.column(i).slice(a, 4096) for i in range(5))
                x = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), dim).astype(np.int64)
                own, upper = own.to_numpy(), upper.to_numpy()
                lower = np.frombuffer(b"".join(lower.to_pylist()), "<f4").reshape(len(raw), k).astype(float)
                upper, lower = _moved(upper, lower, own, before, after)
                own, upper, lower, _ = assign(x, own, upper, lower, after)
                distance = pa.array(squared(x, after[own]))
                yield pa.RecordBatch.from_arrays([ids, raw, pa.array(own, pa.int32()), pa.array(upper), packed(_floor32(lower), "<f4"), distance], names=schema.names)

    return state.select("_id", "_x", "cluster", "upper", "lower").mapInArrow(run, schema)


def _start(rows: DataFrame, k: int, dim: int, kind: str) -> DataFrame:
    """State before the first assignment: bounds that say nothing."""
    schema = StructType([rows.schema["_id"], *StructType.fromDDL("_x binary, cluster int, upper double, lower binary").fields])
    nothing = np.zeros(k, "<f4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                n = part.num_rows
                columns = [packed(matrix(part.column(1), dim), kind), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, np.inf)), pa.array([nothing] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return rows.select("_id", "_v").mapInArrow(run, schema)


def _means(state: DataFrame, centroids: np.ndarray, kind: str) -> np.ndarray:
    """Floors of the componentwise means of clusters; one without vectors stays where it is."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).reshape(len(own), dim)
            count += np.bincount(own, minlength=k)
            total += ((own == np.arange(k)[:, None]).astype(float) @ x.astype(float)).astype(np.int64)  # exact: a batch has few rows
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = state.select("cluster", "_x").mapInArrow(run, "cluster int, n long, s array<long>")
    each = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).where(F.col("n") > 0).collect():  # at most k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    return out


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after so many rounds of assignment and update, and a last assignment.

    Centroids start as the k vectors with the smallest sha256 of seed:id.
    """
    numbers = F.transform("_v", lambda x: F.floor(x * SCALE).cast("double")).alias("_v")
    found = valid(rows, vector_col).where(F.size(vector_col) == dim).select(F.col(id_col).alias("_id"), numbers)
    most = found.agg(F.max(F.array_max(F.transform("_v", F.abs)))).first()[0]
    out = StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if most is None:
        return rows.sparkSession.createDataFrame([], StructType([rows.schema[id_col], *out.fields]))
    if most >= LARGEST:
        raise ValueError(f"a component is {most:g} after scaling; from {LARGEST} on distances are no longs")
    kind = "<i2" if most < 2**15 else "<i4"
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))), 256)
    first = found.orderBy(order, "_v").limit(k).select("_v").collect()
    centroids = before = np.array([r["_v"] for r in first]).astype(np.int64)
    state = _start(found, len(centroids), dim, kind)
    for _ in range(rounds):
        state = save(_round(state, before, centroids, dim, kind), "clustering")
        before, centroids = centroids, _means(state, centroids, kind)
    state = save(_round(state, before, centroids, dim, kind), "clustering").select("_id", "cluster", "distance")
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return state.select(
        F.col("_id").alias(id_col), "cluster", "distance", of([inertia.get(c) for c in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"),
    )
