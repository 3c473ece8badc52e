"""What the settings and the jobs say of a stream, batch by batch: which changes are carried over, as what, and what somebody has to be told.

A batch is joined with tables read anew for it, and what has been told is kept in a published table: a batch that is done again after a restart finds
its own name there and tells nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators import jobs
from tandem.operators.predicates import Condition, direction_allows, route
from tandem.sources import versions


def routed(changes: DataFrame, records: DataFrame, settings: DataFrame, routes: list[tuple[str, list[Condition]]]) -> DataFrame:
    """Changes (system, source_id, change) that may be carried over, with the type of their record as it is now: the first of routes whose conditions hold.

    settings: (type, direction, enabled). A deleted record has no fields to test; it goes by the type that it was linked as (linked_type of records, null if it
    was not), and so does a record that is no longer there, or has nothing in any field.
    """
    fields = [c for c in records.columns if c not in ("id", "linked_type")]
    there = records.withColumnRenamed("id", "source_id").withColumn("_there", F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull() if fields else F.lit(True))
    found = changes.join(there, "source_id", "left")
    gone = (F.col("change") == "deleted") | ~F.coalesce("_there", F.lit(False))
    live = route(found.where(~gone), routes)
    dead = found.where(gone).withColumn("type", F.col("linked_type")).where(F.col("type").isNotNull())
    typed = live.unionByName(dead.select(*live.columns)).drop("_there", "linked_type", *fields)
    return typed.join(settings, "type").where(direction_allows(F.col("direction"), F.col("enabled"), F.col("system"))).drop("direction", "enabled")


def told_once(states: DataFrame, path: str, checkpoint: str, tell: Callable[[DataFrame, int], None] = lambda digest, batch: None):
    """Keeps, in the published table at path, jobs (event_key, status, attempts, ...) that need attention, each once for each state they got into, and calls tell with a
    digest of what is new in a batch (one row: how many there are and the first lines)."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        name = f"{checkpoint}#{number}"
        now = versions.version(spark, path)
        if now is not None and name in now.batches:
            return
        told = versions.opened(spark, path).select("alert_key") if now is not None else spark.createDataFrame([], "alert_key string")
        fresh = jobs.new_alerts(rows, told).dropDuplicates(["alert_key"])
        before = 0 if now is None else len(now.folders)
        number_now = versions.append(fresh, path, name)
        mine = versions.version(spark, path, number_now).folders[before:]
        new = spark.read.schema(fresh.schema).parquet(*mine)
        if new.take(1):
            tell(jobs.digest(new.withColumnRenamed("event_key", "event_id")), number)

    return states.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
