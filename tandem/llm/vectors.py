"""Vectors packed as bytes: reading them, classes of equal ones, and the best of a block of candidates for a block of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and queries that meet it at a time.
BLOCK, QUERIES = 4096, 4096


def valid(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector and components are neither null nor infinite nor NaN, as doubles in column _v."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col(vector_col).isNotNull() & F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return df.where(good).withColumn("_v", v)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter ones are filled up with zeros."""
    lists = column.to_pylist() if column.null_count else None
    if lists is None:
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
        if len(sizes) and (sizes == dim).all():
            return flat.reshape(-1, dim).astype(float)
        lists = column.to_pylist()
    out = np.zeros((len(lists), dim))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def unpacked(column: pa.Array | pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    """Rows of numbers that were packed with tobytes, as doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), dim).astype(float) if rows else np.zeros((0, dim))


def packed(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary())


def pack(df: DataFrame, dim: int, kind: str) -> DataFrame:
    """(_id, _x): the lists of column _v as bytes of numbers of a numpy kind, filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([part.column(0), packed(matrix(part.column(1), dim), kind)], names=["_id", "_x"])

    return df.select("_id", "_v").mapInArrow(run, "_id long, _x binary")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(_n, _id, copies, _x): distinct pairs of an id and a vector, numbered, with their rows counted up to k.

    Of equal vectors the k + 1 smallest ids stay: ties go to smaller ids, so no query's best k (one of the ids may be its own)
    holds another one. Both steps are done before the shuffle too, so a vector that a third of all rows share is no load.
    """
    pairs = rows.groupBy("_x", "_id").agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("_x").orderBy("_id"))
    kept = pairs.withColumn("_place", place).where(F.col("_place") <= k + 1)
    return kept.select(F.monotonically_increasing_id().alias("_n"), "_id", "copies", "_x")


def asking(rows: DataFrame, is_query) -> DataFrame:
    """(query, _x): one row for each id that asks; of rows with one id and several vectors the one of the least bytes."""
    return rows.where(is_query(F.col("_id"))).groupBy(F.col("_id").alias("query")).agg(F.min("_x").alias("_x"))


def over_packed(df: DataFrame, columns: list[str], dim: int, kind: str, extra: str, per_batch: Callable, step: int = 2048) -> DataFrame:
    """Runs per_batch(matrix, batch) over rows with bytes _x: it returns (row numbers or None for all, arrays of the extra columns).

    The columns and _x stay.
    """
    columns = [*columns, "_x"]
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns), extra])
    names = [*columns, *(x.split()[0] for x in extra.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, arrays = per_batch(unpacked(part.column(len(columns) - 1), dim, kind), part)
                own = [part.column(i) if rows is None else part.column(i).take(pa.array(rows, pa.int64())) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=names)

    return df.select(*columns).mapInArrow(run, fields)


def solved(candidates: DataFrame, queries: DataFrame, keys: list[str], dim: int, kind: str, k: int, scores: Callable, number: str) -> DataFrame:
    """The k best candidates of each query within each block: (query_id, _n, vec_id, copies, _s).

    candidates: (keys, bucket, _n, _id, copies, _x); queries: (keys, bucket, query, _x). Within a block a query meets the rows of
    its buckets only. scores(query, rows, most) gives numbers of which smaller is better, most being the block's largest
    component; rows of the query's own id are left out, ties go to the smaller id.
    """
    sql = {"int64": "long", "float64": "double"}[number]

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            rows = rows.sort_by([("bucket", "ascending"), ("_id", "ascending")])
            bucket, n, ids, copies = (rows[c].to_numpy() for c in ("bucket", "_n", "_id", "copies"))
            x, q, names = unpacked(rows["_x"], dim, kind), unpacked(asked["_x"], dim, kind), asked["query"].to_numpy()
            low, high = (np.searchsorted(bucket, asked["bucket"].to_numpy(), side) for side in ("left", "right"))
            order = np.argsort(names, kind="stable")
            edge = np.flatnonzero(np.diff(names[order], prepend=names[order][:1] - 1, append=names[order][-1:] + 1))
            most = float(np.abs(x).max())
            for a, b in zip(edge[:-1], edge[1:]):
                mine = order[a:b]
                if b - a == 1:
                    spot = np.arange(low[mine[0]], high[mine[0]])
                    s = scores(q[mine[0]], x[low[mine[0]] : high[mine[0]]], most)
                else:
                    spot = np.concatenate([np.arange(low[i], high[i]) for i in mine])
                    s = scores(q[mine[0]], x[spot], most)
                other = ids[spot] != names[mine[0]]
                spot, s = spot[other], s[other]
                if len(s) > k:
                    near = np.flatnonzero(s <= np.partition(s, k - 1)[k - 1])
                    spot, s = spot[near], s[near]
                first = np.lexsort((n[spot], ids[spot], s))[:k]
                out += [(names[mine[0]], n[spot[i]], ids[spot[i]], copies[spot[i]], s[i]) for i in first]
        found = list(zip(*out)) or [()] * 5
        arrays = [pa.array(np.asarray(c, t)) for c, t in zip(found, ("int64", "int64", "int64", "int64", number))]
        return pa.table(arrays, names=["query_id", "_n", "vec_id", "copies", "_s"])

    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(best, f"query_id long, _n long, vec_id long, copies long, _s {sql}")


def ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query over all blocks, each as often as it is there: (query_id, rank, vec_id, _s)."""
    order = Window.partitionBy("query_id").orderBy("_s", "vec_id", "_n")
    few = best.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= k).dropDuplicates(["query_id", "_n"])
    each = few.select("query_id", "_n", "vec_id", "_s", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_s", "vec_id", "_n", "_copy"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "_s")
