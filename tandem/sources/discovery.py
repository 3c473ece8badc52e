"""What a system tells of itself: objects, fields, and the events that it sends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(described: DataFrame) -> DataFrame:
    """Schema rows (system, native, type, required, read_only, n_options) of described fields.

    described: (system, native, type, nillable, defaulted, updateable, options), options an array of (value, active). A field is required
    if it must have a value and gets none by itself; values that are no longer in use do not count.
    """
    active = F.filter(F.coalesce("options", F.array().cast("array<struct<value:string,active:boolean>>")), lambda o: o["active"])
    return described.select("system", "native", "type", (~F.col("nillable") & ~F.col("defaulted")).alias("required"), (~F.col("updateable")).alias("read_only"), F.size(active).alias("n_options"))


def table_fields(df: DataFrame, system: str) -> DataFrame:
    """The columns of a table as schema rows; what may not be null is required."""
    rows = [(system, f.name, f.dataType.typeName(), not f.nullable, False, 0) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "system string, native string, type string, required boolean, read_only boolean, n_options int")


def objects(standard: DataFrame, custom: DataFrame) -> DataFrame:
    """Objects (name, label) of a system: the standard ones, and custom ones whose name is not taken."""
    return standard.select("name", "label").unionByName(custom.select("name", "label").join(standard.select("name"), "name", "left_anti"))


def posted_events(posts: DataFrame, types: DataFrame, system: str) -> DataFrame:
    """Change events of posted bodies (column body): JSON arrays of events; types: (object_id, type). Events of unknown objects go.

    The change is told by the end of the subscription's name, the time by milliseconds since 1970. An event is known by a hash of all six parts that
    tell it from others, any of which may be missing; one without a time has happened now.
    """
    schema = "array<struct<portalId:string,subscriptionId:string,eventId:string,objectId:long,objectTypeId:string,subscriptionType:string,occurredAt:long>>"
    rows = posts.select(F.explode(F.from_json("body", schema)).alias("e")).select("e.*")
    name = F.col("subscriptionType")
    change = F.when(name.endswith("creation"), "created").when(name.endswith("deletion"), "deleted").otherwise("updated")
    identity = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("portalId", "subscriptionId", "eventId", "subscriptionType", "objectId", "occurredAt")])
    found = rows.join(types.select(F.col("object_id").alias("objectTypeId"), "type"), "objectTypeId")
    return found.select(F.concat(F.lit(f"{system}:"), F.sha2(identity, 256)).alias("event_key"), "type", F.col("objectId").cast("string").alias("source_id"), change.alias("change"), F.coalesce(F.timestamp_millis("occurredAt"), F.current_timestamp()).alias("occurred_at"))


def posted_changes(posts: DataFrame, types: DataFrame, system: str, resolved: DataFrame | None = None) -> DataFrame:
    """Change events of posted bodies (column body): JSON objects with a list of events, each naming its object, record, change and time.

    types: (object_id, type). An object of several types is told apart by resolved (object_id, source_id, type), what its record is now; without that, or without a
    type, the event goes. One that names no change is an update, one without a time has happened now; an event is known by a hash of what it says.
    """
    schema = "events array<struct<sobject:string,recordId:string,changeType:string,occurredAt:string>>"
    rows = posts.select(F.inline(F.from_json("body", schema)["events"])).where(F.col("recordId").isNotNull())
    said = [F.coalesce(F.col(c), F.lit("")) for c in ("sobject", "recordId", "changeType", "occurredAt")]
    each = types.groupBy("object_id").agg(F.count_distinct("type").alias("_n"), F.min("type").alias("_only"))
    found = rows.join(each, rows["sobject"] == each["object_id"])
    if resolved is None:
        found = found.withColumn("type", F.when(F.col("_n") == 1, F.col("_only")))
    else:
        now = resolved.select(F.col("object_id").alias("sobject"), F.col("source_id").alias("recordId"), F.col("type").alias("_now"))
        found = found.join(now, ["sobject", "recordId"], "left").withColumn("type", F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.col("_now")))
    key = F.concat(F.lit(f"{system}:"), F.sha2(F.concat_ws(":", *said), 256))
    moment = F.coalesce(F.col("occurredAt").try_cast("timestamp"), F.current_timestamp())
    return found.where("type IS NOT NULL").select(key.alias("event_key"), "type", F.col("recordId").alias("source_id"), F.coalesce("changeType", F.lit("updated")).alias("change"), moment.alias("occurred_at"))


def polled_changes(rows: DataFrame, system: str, type_: str, id_col: str, changed: str, deleted: bool = False) -> DataFrame:
    """Change events of rows that a poll has found changed, or deleted: known by what and when, so that what two polls meet is one event."""
    iso = F.date_format(F.to_utc_timestamp(changed, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    key = F.concat_ws(":", F.lit(system), F.lit("poll"), F.lit(system), F.lit(type_), F.col(id_col).cast("string"), *([F.lit("deleted")] if deleted else []), iso)
    change = F.lit("deleted" if deleted else "updated")
    return rows.select(key.alias("event_key"), F.lit(system).alias("system"), F.lit(type_).alias("type"), F.col(id_col).cast("string").alias("source_id"), change.alias("change"), F.col(changed).alias("occurred_at"))


def new_snapshots(held: DataFrame, seen: DataFrame) -> DataFrame:
    """Schemas (system, type, hash) that have not been seen in this form, each once; to be appended."""
    return seen.dropDuplicates(["system", "type", "hash"]).join(held.select("system", "type", "hash"), ["system", "type", "hash"], "left_anti")


def since_last_scan(df: DataFrame, column: str, started_at, minutes: int = 5) -> DataFrame:
    """Rows changed since the last scan started, less a few minutes for clocks that differ; what is met twice is dropped by its event key."""
    from_ = F.timestamp_add("MINUTE", F.lit(-minutes), F.lit(started_at).cast("timestamp"))
    return df.where(F.col(column) >= from_)
