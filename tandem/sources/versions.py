"""Tables in versions: what is written is seen when it is published, whole or not at all, and who reads goes on reading the version that was there.

A table is a folder of data folders, which never change once written, and of manifests, one a version, which name the data folders of that version. A
write makes a new data folder and then publishes a manifest; a reader takes the newest manifest and keeps to it. Both are written by Spark's own commit, so
a write that is lost with its executors leaves a data folder that no manifest names. A batch that carries a name is written once: a replay finds the
name in the manifest and changes nothing. One writer at a time; a second one that publishes the same version fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources.stores import upserted

_MANIFEST = "version long, folders array<string>, batches array<string>, schema string"


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def version(spark: SparkSession, path: str, number: int | None = None):
    """The manifest of the newest version, or of one that is named; null for a table that is not there."""
    found = _manifests(spark, path)
    if found is None:
        return None
    return (found if number is None else found.where(F.col("version") == number)).orderBy(F.desc("version")).first()


def opened(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the newest version (or of a named one) as it is now: later writes do not change this frame."""
    now = version(spark, path, number)
    if now is None:
        raise ValueError(f"no such table or version: {path}")
    return spark.read.schema(now.schema).parquet(*now.folders) if now.folders else spark.createDataFrame([], now.schema)


def _published(spark: SparkSession, path: str, before, folders: list[str], batch: str | None, schema: str) -> int:
    number = 1 if before is None else before.version + 1
    batches = [*(before.batches if before else []), *([batch] if batch is not None else [])]
    spark.createDataFrame([(number, folders, batches, schema)], _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/{number:012d}")
    return number


def _write(df: DataFrame, path: str, batch: str | None, keep: bool) -> int:
    spark = df.sparkSession
    before = version(spark, path)
    if before is not None and batch is not None and batch in before.batches:
        return before.version
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    if keep and before is not None and before.schema != schema:
        raise ValueError(f"rows of other columns: {schema} for {before.schema}")
    return _published(spark, path, before, [*(before.folders if keep and before else []), folder], batch, schema)


def append(df: DataFrame, path: str, batch: str | None = None) -> int:
    """Adds rows as a new version, whose number it returns; a batch whose name is there already adds nothing."""
    return _write(df, path, batch, keep=True)


def replace(df: DataFrame, path: str, batch: str | None = None) -> int:
    """Makes the rows of df the new version; df may read the table itself."""
    return _write(df, path, batch, keep=False)


def upsert(changes: DataFrame, path: str, keys: list[str], batch: str | None = None) -> int:
    """Publishes the table with changes laid over by key, or the changes where there is no table."""
    now = version(changes.sparkSession, path)
    return replace(changes if now is None else upserted(opened(changes.sparkSession, path), changes, keys), path, batch)
