"""Change events as a stream: delivered at least once, counted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.sources import versions


def event_stream(spark: SparkSession, folder: str, name: str, parse: Callable[[DataFrame], DataFrame], files_per_trigger: int = 8) -> DataFrame:
    """The Parquet files of a table as a stream, parsed into change events."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return parse(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}*.parquet").parquet(folder))


def unique_events(changes: DataFrame, delay: str | None = "7 days") -> DataFrame:
    """Each event once within the delay of a watermark, so that the state stays small; for ever where there is no delay."""
    if delay is None:
        return changes.dropDuplicates(["event_key"])
    return changes.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_key"])


def counts_by_change(changes: DataFrame) -> DataFrame:
    return changes.groupBy("system", "change").agg(F.count("*").alias("n"))


def drained(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation over all that is there. Each batch publishes the whole result as a new version of the table at path; returns the last one."""
    publish = lambda batch, number: versions.replace(batch, path, f"{checkpoint}#{number}")
    df.writeStream.outputMode("complete").foreachBatch(lambda batch, number: publish(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return versions.opened(df.sparkSession, path)


def store(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """The store of events at a path, which is made if it is not there; by day."""
    schema = changes.schema.add("day", "date")
    spark.createDataFrame([], schema).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.schema(schema).parquet(path)


def into_store(changes: DataFrame, path: str, checkpoint: str):
    """Appends new events to a Parquet store by day: a batch drops what the store already holds, so replays change nothing.

    A redelivered event keeps its time, so only the days of the batch are read (those without a time are a day of their own); their list is all that the driver sees.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["event_key"]).withColumn("day", F.to_date("occurred_at"))
        days = [r.day for r in batch.select(F.to_date("occurred_at").alias("day")).distinct().collect()]
        held = store(batch.sparkSession, path, batch).where(F.col("day").isin([d for d in days if d]) | (F.col("day").isNull() & F.lit(None in days))) if days else None
        if held is not None:
            new.join(held.select("event_key"), "event_key", "left_anti").write.mode("append").partitionBy("day").parquet(path)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_current(changes: DataFrame, records: DataFrame) -> DataFrame:
    """Changes with the record as it is now: an event only points to it. One that has vanished since is told apart."""
    now = records.withColumnRenamed("id", "source_id").withColumn("_there", F.lit(True))
    return changes.join(now, "source_id", "left").withColumn("vanished", F.col("_there").isNull() & (F.col("change") != "deleted")).drop("_there")


def each_batch(changes: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Appends what work makes of each batch (a join with tables read anew, say) to a Parquet table."""
    return changes.writeStream.foreachBatch(lambda batch, _: work(batch).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
