"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by pseudo-rotations, three rounds of random signs and a Hadamard transform, and assigns each
vector to the nearest signed axis. Several such hashes are put together: a whole one, and one of its first axes only, so that
the number of buckets of a table can follow the number of rows: it doubles whenever there are 16 times as many. Tables and
probes are the same for every input. A query is sent to the buckets it is nearest to, by the sum of squared gaps to its
best axes, and the rows there are ranked by their exact distance. Every row is indexed in every table.

Buckets are dealt to blocks; a block with many rows or many queries is split into parts of bounded size, and only such a block is
met by more than one set of queries. Equal vectors are indexed once, with the smallest ids.

Nearness is the Euclidean distance of the original vectors in double precision. Vectors that are null, zero or hold null
or non-finite components take no part; shorter vectors count as filled up with zeros. Rows of one id are each candidates,
and none is one of the query of that id; of repeated query rows one asks. Null ids take no part.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import save
from .vectors import BLOCK, QUERIES, asking, classes, over_packed, pack, ranked, solved, valid

#: Tables, and buckets that a query looks up in each.
TABLES, PROBES = 40, 16
#: Bits of the hashes after the first, for so many rows and fewer.
BITS, ROWS = 3, 250


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows, whose length is a power of two; keeps lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=512)
def rotation(dim: int, table: int, part: int) -> np.ndarray:
    """The pseudo-rotation of a hash as one matrix, from dim to the next power of two: the transform of the unit vectors."""
    d = 1 << max(1, (dim - 1).bit_length())
    y = np.eye(dim, d)
    for s in np.random.default_rng([17, table, part]).choice([-1.0, 1.0], (3, d)):
        y = hadamard(y * s)
    return y.astype(np.float32)


def widths(n: int, dim: int) -> list[int]:
    """Bits of each hash of a table for n rows: all axes of the first, then as many as the number of rows asks for."""
    whole = max(1, (dim - 1).bit_length()) + 1
    left = BITS + max(0, round(math.log2(max(n, ROWS) / ROWS) / 4))
    out = [whole]
    while left > 0:
        out.append(min(left, whole))
        left -= out[-1]
    return out


def buckets(x: np.ndarray, table: int, bits: list[int], probes: int = 1) -> np.ndarray:
    """Numbers of the buckets nearest to each row, nearest first."""
    unit = (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)
    number, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for part, b in enumerate(bits):
        y = unit @ rotation(x.shape[1], table, part)
        y = y[:, : 1 << (b - 1)] * np.float32(math.sqrt(y.shape[1] / (1 << (b - 1))))
        both = np.concatenate((y, -y), 1)
        few = min(probes, both.shape[1])
        near = np.argsort(-both, axis=1, kind="stable")[:, :few]
        gap = np.take_along_axis(both, near, 1)
        gap = (gap[:, :1] - gap) ** 2
        number = (number[:, :, None] * (1 << b) + near[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        number, loss = np.take_along_axis(number, keep, 1), np.take_along_axis(loss, keep, 1)
    return number + (table << sum(bits))


def search(rows: DataFrame, is_query, k: int = 10, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each query row; is_query: a condition on the id."""
    kind = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    found = valid(rows, vector_col).where(F.col(id_col).isNotNull() & F.exists("_v", lambda x: x != 0)).select(F.col(id_col).cast("long").alias("_id"), "_v")
    dim = max(found.agg(F.max(F.size("_v"))).first()[0] or 0, 1)
    found = save(pack(found, dim, kind), "near-rows")
    once = save(classes(found, k), "near-classes")
    n = once.count()
    bits = widths(n, dim)
    shift = max(0, sum(bits) - max(0, (n // BLOCK)).bit_length())  # of a bucket's number: so many buckets make a block of some BLOCK rows

    def index(x: np.ndarray, _):
        return None, [pa.array(np.concatenate([buckets(x, t, bits) for t in range(tables)], 1).tolist(), pa.list_(pa.int64()))]

    def look_up(q: np.ndarray, _):
        return None, [pa.array(np.concatenate([buckets(q, t, bits, probes) for t in range(tables)], 1).tolist(), pa.list_(pa.int64()))]

    indexed = save(over_packed(once, ["_n", "_id", "copies"], dim, kind, "_b array<bigint>", index), "near-index")
    asked = save(over_packed(asking(found, is_query), ["query"], dim, kind, "_b array<bigint>", look_up), "near-asked")
    block = F.shiftright("bucket", shift).alias("block")
    places = indexed.select(F.explode("_b").alias("bucket"), "_n", "_id", "copies", "_x").select("*", block)
    looks = asked.select(F.explode("_b").alias("bucket"), "query", "_x").select("*", block)
    many = indexed.select(F.explode("_b").alias("bucket")).groupBy(block).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    turns = asked.select("query", F.explode("_b").alias("bucket")).select("query", block).distinct().groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    sizes = save(many.join(turns, "block"), "near-blocks")  # blocks that a query looks at
    zero = F.lit(0).cast("long")
    candidates = places.join(sizes, "block").select("block", F.pmod(F.xxhash64("_n"), "parts").alias("part"), F.explode(F.sequence(zero, F.col("turns") - 1)).alias("turn"), "bucket", "_n", "_id", "copies", "_x")
    queries = looks.join(sizes, "block").select("block", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query"), "turns").alias("turn"), "bucket", "query", "_x")

    def distances(q: np.ndarray, x: np.ndarray, _) -> np.ndarray:
        return np.sqrt(((x - q) ** 2).sum(1))

    best = solved(candidates, queries, ["block", "part", "turn"], dim, kind, k, distances, "float64")
    return ranked(best, k).withColumnRenamed("_s", "score")
