"""Tables written between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tandem.sources.stores import shared_folder


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Cuts the lineage: what was written survives the loss of executors, and later steps read it instead of doing the
    work again. The files stay until the folder is cleared, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch handed to Python; Spark's own limit of 64 MB is held several times over by each task.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow with small batches, so that whole texts need little memory outside the heap. A limit that the session sets itself stays."""
    spark = df.sparkSession
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH)
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lowest_id(df: DataFrame, column: str):
    """The lowest value of an id's type."""
    kind = df.schema[column].dataType.simpleString()
    return F.lit("") if kind == "string" else F.lit(-1).cast(kind) if kind in ("tinyint", "smallint") else F.lit(-(2**31)).cast(kind) if kind == "int" else F.lit(-(2**63)).cast(kind)


def filled_id(df: DataFrame, column: str):
    """The id with nulls replaced by a lowest value, so that it can be a join key."""
    return F.coalesce(F.col(column), lowest_id(df, column))
