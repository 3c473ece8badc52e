"""Whitening of embeddings by principal components.

Entries become integers, so that sums are exact. Rows are centred before anything is multiplied: (n * x - S) / n, with an exact integer
above. Spark MLlib's computeSVD of the centred rows, as a distributed row matrix, gives singular values s and right singular vectors; the
eigenvalues of the covariance are s ** 2 / n. Total variance is computed apart from that, from the rows' exact deviations, so that shares of
it do not rest on the decomposition. A row's whitened values are its centred entries projected on a component, over the root of the eigenvalue.

One pass sums, one collects the matrix of products (components by components, the only thing that grows with the number of
entries of a vector and not with rows), one projects; means and products of the whitened values take two passes over the few values written.

Rows whose vector is null or holds null or non-finite entries are dropped; shorter vectors count as filled up with zeros. Null and repeated ids and
equal rows are kept, each row counting once. Components whose eigenvalue is zero, up to rounding, do not exist: equal
rows, a single row or an empty table give no rows. Deviations that do not fit a long are null; all else uses their exact values.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import save
from .vectors import matrix, valid

SCALE, SHIFT = 1024, 100_000
#: Singular values under this share of the largest are rounding: products are summed in double precision, where 1e-14 of a variance is lost.
SMALLEST = 2e-7


def whiten(rows: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and each of the first k components.

    identity_error: the largest absolute entry of the whitened values' covariance minus the identity, over all rows.
    """
    numbers = valid(rows, vector_col).select(F.col(id_col).alias("_id"), F.transform("_v", lambda c: F.floor(c * SCALE) + SHIFT).alias("_x"))
    dim = numbers.agg(F.max(F.size("_x"))).first()[0] or 0
    out = StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    schema = StructType([rows.schema[id_col], *out.fields])
    spark = rows.sparkSession
    if not dim:
        return spark.createDataFrame([], schema)
    numbers = numbers.withColumn("_x", F.concat("_x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dim) - F.size("_x"))))
    first = numbers.agg(F.count("*").alias("n"), *[F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(dim)]).first()
    n, sums = first["n"], [first[f"s{i}"] for i in range(dim)]
    centred = F.zip_with("_x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: (x * n - s).cast("double") / n)
    vectors = MLUtils.convertVectorColumnsFromML(numbers.select(array_to_vector(centred).alias("v")), "v")
    if not numbers.where(F.exists(F.zip_with("_x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: x * n - s), lambda d: d != 0)).take(1):
        return spark.createDataFrame([], schema)
    svd = RowMatrix(vectors, n, dim).computeSVD(dim, rCond=SMALLEST)
    values = svd.s.toArray()[:k] ** 2 / n
    axes = svd.V.toArray()[:, : len(values)]
    done = save(_projected(numbers, n, np.array(sums, np.int64), axes / np.sqrt(values)), "whitened")
    trace = done.agg(F.sum(F.col("deviation").cast("double") / float(n) ** 2)).first()[0] / n
    found = done.select("_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("w"))
    shares = F.array(*[F.lit(float(e / trace)) for e in values])
    return found.select(
        F.col("_id").alias(id_col), (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("col").alias("whitened"),
        F.element_at(shares, F.col("pos") + 1).alias("explained"), F.lit(_from_identity(done, len(values))).alias("identity_error"),
    )


def _projected(numbers: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(_id, deviation, w): the exact sum of squares of n * x - S, and the centred entries times the axes."""
    schema = StructType([numbers.schema["_id"], *StructType.fromDDL("deviation decimal(38,0), w array<double>").fields])
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                far = matrix(part.column(1), dim).astype(np.int64) * n - sums
                if float(np.abs(far).max()) ** 2 * dim < 2**62:
                    deviation = pa.array((far * far).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([Decimal(sum(int(d) ** 2 for d in row)) for row in far], pa.decimal128(38, 0))
                w = (far / n) @ axes
                offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=schema.names)

    return numbers.select("_id", "_x").mapInArrow(run, schema)


def _from_identity(done: DataFrame, k: int) -> float:
    """How far the covariance of the lists w of k values is from the identity, each centred on its mean before it is multiplied."""
    w = [F.col("w")[i] for i in range(k)]
    mean = done.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(w)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = done.agg(*[F.avg((w[i] - mean[i]) * (w[j] - mean[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return float(max(abs(p - (i == j)) for p, (i, j) in zip(products, pairs)))
