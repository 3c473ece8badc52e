"""Reading record tables and keeping stores up to date.

Stores are plain Parquet tables; a keyed write makes a new version of the rows and leaves the swap of folders to the caller.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset and all run on one machine, a temporary folder is set; on a cluster that folder would be another one for every
    executor, so its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later steps neither do its work again nor depend on the executors that did it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Settings or identity maps kept as one JSON document a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def since(df: DataFrame, column: str, moment, inclusive: bool = True) -> DataFrame:
    """Rows changed since a moment; the comparison reaches the Parquet scan."""
    c = F.col(column)
    return df.where(c >= moment if inclusive else c > moment)


def deleted_between(before: DataFrame, after: DataFrame, key: str = "id", at: Column | None = None) -> DataFrame:
    """Keys of an earlier snapshot that a later one lacks; with the later one's moment as deleted_at, if it is given."""
    gone = before.select(key).join(after.select(key), key, "left_anti")
    return gone if at is None else gone.withColumn("deleted_at", at)


def schema_rows(df: DataFrame, table: str) -> DataFrame:
    """The columns of a frame as rows."""
    rows = [(table, f.name, f.dataType.typeName(), f.nullable, i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "object string, field string, type string, nullable boolean, position int")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order given."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") == 1).drop("_r")


def upserted(store: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The store with changes laid over: changed rows replace stored ones of the same key. Keys in changes are unique."""
    return store.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def patched(store: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the non-null values of changes laid over, and new keys added."""
    kept = [c for c in store.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept if c in changes.columns])
    joined = store.join(new, keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in kept])


def inserted_if_absent(store: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows whose key the store lacks, the first of each key."""
    return latest(rows, keys, *order).join(store.select(*keys), keys, "left_anti")


def deleted(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(gone.select(*keys), keys, "left_anti")


def added_up(store: DataFrame, rows: DataFrame, keys: list[str], quantity: str) -> DataFrame:
    """Counters: quantities of rows added to those of the store."""
    return store.select(*keys, quantity).unionByName(rows.select(*keys, quantity)).groupBy(*keys).agg(F.sum(quantity).alias(quantity))


def replace_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Overwrites the partitions that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
