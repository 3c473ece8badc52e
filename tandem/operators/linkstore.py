"""The store of links in three tables: links, their sides by system, and the natural keys that find them.

Writes come in any number and order, each with its place in a sequence, and are laid over what is held by the later one of each key: a link has the
type and time of its last write; a side has what the last write that named its native id said of it, nothing kept from earlier ones; a natural key belongs
to the newest link that was written with it. Each table is one aggregation by its key, partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS = "link_id string, type string, updated_at timestamp"
SIDES = "link_id string, system string, native_id string, content_hash string, modified_at timestamp"
KEYS = "type string, natural_key string, link_id string"


def _newest(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: that of the last write, or the one that is held. new carries seq."""
    values = [c for c in held.columns if c not in keys]
    both = held.withColumn("seq", F.lit(None).cast(new.schema["seq"].dataType)).unionByName(new.select(*held.columns, "seq"))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col("seq").isNotNull(), "seq")).alias("l"))
    return last.select(*[F.col(c) if c in keys else F.col(f"l.{c}") for c in held.columns])


def written(links: DataFrame, sides: DataFrame, keys: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after writes (seq, link_id, type, at, sides, natural_keys); sides is an array of structs (system, native_id, content_hash, modified_at)."""
    new_links = writes.select("seq", "link_id", "type", F.col("at").alias("updated_at"))
    new_sides = writes.select("seq", "link_id", F.inline("sides")).where(F.coalesce("native_id", F.lit("")) != "")
    new_keys = writes.select("seq", "link_id", "type", F.explode(F.array_distinct("natural_keys")).alias("natural_key")).where(F.col("natural_key").isNotNull())
    return _newest(links, new_links, ["link_id"]), _newest(sides, new_sides, ["link_id", "system"]), _newest(keys, new_keys, ["type", "natural_key"])


def clashes(sides: DataFrame) -> DataFrame:
    """(system, native_id, links): records that several links hold as theirs, which a store with a unique key would have refused."""
    return sides.groupBy("system", "native_id").agg(F.count("*").alias("links")).where("links > 1")


def found_by(links: DataFrame, sides: DataFrame, keys: DataFrame) -> DataFrame:
    """Links as reconciliation reads them (link_id, source_id, target_id, source_hash, target_hash, updated_at, keys): a from the first system, b from the second."""
    side = lambda system, names: sides.where(F.col("system") == system).select("link_id", F.col("native_id").alias(names[0]), F.col("content_hash").alias(names[1]))
    own = keys.groupBy("link_id").agg(F.array_sort(F.collect_set("natural_key")).alias("keys"))  # the keys of one link
    wide = links.select("link_id", "updated_at").join(side("a", ("source_id", "source_hash")), "link_id", "left").join(side("b", ("target_id", "target_hash")), "link_id", "left").join(own, "link_id", "left")
    return wide.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
