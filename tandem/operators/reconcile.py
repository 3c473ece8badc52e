"""Matching, field differences, plans, conflict resolution and what follows from them.

Records come as frames of id, key (natural key or null), modified and one column for each field. Links come as
source_id, target_id, target_hash and, where known, source_hash and key. All keys are joined by equality; a null key is
replaced by one that matches nothing and differs from row to row, so that such rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import content_hash, duplicate_conflict, text, vendor_message


def spread(key: str) -> Column:
    """The key, or what no key equals."""
    return F.coalesce(F.col(key), F.concat(F.lit("\x01"), F.col("id")))


def with_hash(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumn("hash", content_hash({f: F.col(f) for f in fields}))


def differences(fields: list[str], a: str, b: str) -> Column:
    """Fields (by name) whose values in structs a and b are not identical, with both values."""
    each = [F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"{a}.{f}").cast("string").alias("source"), F.col(f"{b}.{f}").cast("string").alias("target"))) for f in sorted(fields)]
    return F.array_compact(F.array(*each))


def candidates(target: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Per natural key: the number of target records, and the first of them, with its fields as struct m where they are named."""
    more = [F.min_by(F.struct(*fields), "id").alias("m")] if fields else []
    return target.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n_candidates"), F.min("id").alias("candidate_id"), *more)


def key_owners(links: DataFrame, value: str) -> DataFrame:
    """(key, value): the link that each natural key finds: the newest that holds it, by updated_at where links have it, then by source id."""
    key = F.explode("keys") if "keys" in links.columns else F.col("key") if "key" in links.columns else F.lit(None).cast("string")
    order = F.struct(*[c for c in ("updated_at", "source_id") if c in links.columns])
    return links.select(key.alias("key"), F.col(value), order.alias("_order")).where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(value, "_order").alias(value))


def preview(source: DataFrame, target: DataFrame, links: DataFrame, fields: list[str]) -> DataFrame:
    """One plan for each source record: source_id, action, target_id, field_diff and warnings; nothing is written.

    A link by id goes before one by natural key. Without a readable linked target the natural key decides: several
    candidates are ambiguous, one is a match, none is created.
    """
    row = F.struct(*fields)
    by_id = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("id_target"), F.col("target_hash").alias("id_hash"), F.lit(True).alias("by_id"))
    found = source.select("id", "key", row.alias("s")).join(by_id, "id", "left")
    if {"key", "keys"} & set(links.columns):
        by_key = key_owners(links.withColumn("k", F.struct("target_id", "target_hash")), "k")
        found = found.withColumn("_key", spread("key")).join(by_key.withColumnRenamed("key", "_key"), "_key", "left")
        pick = lambda a, b: F.when(F.col("by_id"), F.col(a)).otherwise(F.col(b))
        found = found.withColumn("id_target", pick("id_target", "k.target_id")).withColumn("id_hash", pick("id_hash", "k.target_hash"))
    rows = target.select(F.col("id").alias("_at"), row.alias("t"), F.lit(True).alias("readable"))
    found = found.withColumn("_at", spread("id_target")).join(rows, "_at", "left")
    found = found.withColumn("_key", spread("key")).join(candidates(target, fields).withColumnRenamed("key", "_key"), "_key", "left")
    one = F.when(F.col("readable").isNull() & (F.col("n_candidates") == 1), F.col("candidate_id"))
    found = found.withColumn("candidate_id", one)
    found = found.withColumn("r", F.coalesce("t", F.when(F.col("candidate_id").isNotNull(), F.col("m")))).withColumn("diff", differences(fields, "s", "r"))
    read, match = F.col("readable").isNotNull(), F.col("candidate_id").isNotNull()
    target_hash = content_hash({f: F.col(f"r.{f}") for f in fields})
    stale = (text(F.col("id_hash")) != "") & (F.col("id_hash") != target_hash)
    action = (
        F.when(~read & (F.coalesce("n_candidates", F.lit(0)) > 1), "ambiguous").when(~read & ~match, "create").when(F.size("diff") == 0, "skip")
        .when(stale, "conflict").when(match & F.col("id_target").isNull(), "match").otherwise("update")
    )
    warning = (
        F.when(F.col("action") == "ambiguous", F.concat(F.col("n_candidates").cast("string"), F.lit(" target records share this natural key")))
        .when((F.col("action") == "create") & F.col("key").isNull(), "record has no configured natural key")
        .when(match, "existing target record will be linked")
    )
    new = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"s.{f}").cast("string").alias("source"), F.lit(None).cast("string").alias("target")) for f in fields])
    return found.withColumn("action", action).select(
        F.col("id").alias("source_id"), "action", F.when(~F.col("action").isin("ambiguous", "create"), F.coalesce(F.when(read, F.col("id_target")), F.col("candidate_id"))).alias("target_id"),
        F.when(F.col("action") == "create", new).when(F.col("action") == "ambiguous", F.slice(new, 1, 0)).otherwise(F.col("diff")).alias("field_diff"),
        F.array_compact(F.array(warning)).alias("warnings"),
    )


def plan_fingerprint() -> Column:
    """What a plan says, as a hash; two plans of a record are the same if theirs are."""
    return F.sha2(F.to_json(F.struct("source_id", "action", "target_id", "field_diff", "warnings")), 256)


def drifted(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Source ids whose frozen plan is no longer what a new preview says, or whose source has gone."""
    a = frozen.select("source_id", plan_fingerprint().alias("was"))
    b = now.select("source_id", plan_fingerprint().alias("is"))
    return a.join(b, "source_id", "left").where(~F.col("was").eqNullSafe(F.col("is"))).select("source_id", F.col("is").isNull().alias("gone"))


def first_per_type(df: DataFrame, n: int) -> DataFrame:
    """At most n records of each type, those with the smallest ids (the order that a limit needs to mean anything)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where(F.col("_r") <= n).drop("_r")


def pairs(a: DataFrame, b: DataFrame, links: DataFrame, fields: list[str]) -> DataFrame:
    """Linked records side by side: structs a and b of the fields, with both times."""
    left = a.select(F.col("id").alias("source_id"), F.struct(*fields, "modified").alias("a"))
    right = b.select(F.col("id").alias("target_id"), F.struct(*fields, "modified").alias("b"))
    return links.select("source_id", "target_id").join(left, "source_id", "left").join(right, "target_id", "left")


def resolve(found: DataFrame, fields: list[str], strategy: str, source_of_truth: str = "a", owners: dict[str, str] | None = None) -> DataFrame:
    """The winning values of linked records a and b.

    source-of-truth takes one side whole. last-write-wins takes the later one, a where times are equal and b where they cannot be compared.
    field-merge takes each field from its owner, or from the later side, and falls back on the other side where that is null. Where a
    side is missing the other wins.
    """
    later = F.coalesce(F.col("a.modified") >= F.col("b.modified"), F.lit(False))
    if strategy == "field-merge":
        out = []
        for f in fields:
            owner = (owners or {}).get(f)
            first = F.lit(owner == "a") if owner else later
            out.append(F.coalesce(F.when(first, F.col(f"a.{f}")).otherwise(F.col(f"b.{f}")), F.col(f"a.{f}"), F.col(f"b.{f}")).alias(f))
        return found.select("source_id", "target_id", *out)
    wins = {"source-of-truth": F.lit(source_of_truth == "a"), "last-write-wins": later}[strategy]
    wins = F.when(F.col("a").isNull(), False).when(F.col("b").isNull(), True).otherwise(wins)
    return found.withColumn("w", F.when(wins, F.col("a")).otherwise(F.col("b"))).select("source_id", "target_id", F.when(wins, "a").otherwise("b").alias("winner"), *[F.col(f"w.{f}").alias(f) for f in fields])


def without_echoes(incoming: DataFrame, links: DataFrame, fields: list[str]) -> DataFrame:
    """Incoming records whose content is not what was last written by us."""
    known = links.select(F.col("source_id").alias("id"), F.col("source_hash").alias("_last"))
    return with_hash(incoming, fields).join(known, "id", "left").where(~F.coalesce(F.col("_last") == F.col("hash"), F.lit(False))).drop("_last")


def write_set(plans: DataFrame) -> DataFrame:
    """What a plan writes: create or update with the changed fields as a map; plans that write nothing go."""
    payload = F.map_from_entries(F.transform("field_diff", lambda d: F.struct(d["field"], d["source"])))
    op = F.when(F.col("action") == "create", "create").otherwise("update")
    return plans.where(F.col("action").isin("create", "update", "match", "conflict")).select("source_id", op.alias("op"), F.coalesce("target_id", F.concat(F.lit("new-"), F.col("source_id"))).alias("target_id"), payload.alias("payload"))


def links_after(plans: DataFrame, source: DataFrame, links: DataFrame, fields: list[str]) -> DataFrame:
    """Links once the plans are carried out: every record that was written or matched has one, with the content hash of the source on both sides."""
    done = plans.where(F.col("action") != "ambiguous").join(with_hash(source, fields).select(F.col("id").alias("source_id"), "hash"), "source_id")
    new = done.select("source_id", F.coalesce("target_id", F.concat(F.lit("new-"), F.col("source_id"))).alias("target_id"), F.col("hash").alias("source_hash"), F.col("hash").alias("target_hash"))
    old = links.join(new, "source_id", "left_anti").select("source_id", "target_id", F.lit(None).cast("string").alias("source_hash"), "target_hash")
    return new.unionByName(old)


def first_of_key(source: DataFrame) -> DataFrame:
    """Which record of each natural key creates the link that the later ones then find, as a loop over them would have it."""
    keyed = source.where(F.col("key").isNotNull())
    lead = F.first("id").over(Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return keyed.withColumn("linked_by", lead).unionByName(source.where(F.col("key").isNull()).withColumn("linked_by", F.col("id")))


def propagated_deletes(deleted: DataFrame, links: DataFrame) -> DataFrame:
    """Target ids to remove for deleted source ids; those without a link ask for nothing."""
    return deleted.select(F.col("id").alias("source_id")).join(links.select("source_id", "target_id"), "source_id")


def retargeted(refused: DataFrame, key_fields: list[str], rules: DataFrame | None = None) -> DataFrame:
    """Refused writes (source_id, target_id, body) that go to the record that holds the value instead.

    Only for a field of the natural key, whose value tells that both are the same record; a clash on any other unique field, or with the
    target itself, stays an error. Errors name native fields: rules (canonical, native) of the target's side tell which canonical ones they are, in
    whatever case; without rules the names are the same on both sides.
    """
    clash = duplicate_conflict(vendor_message(F.col("body")))
    found = refused.withColumn("_clash", clash).withColumn("_native", F.lower("_clash.property"))
    if rules is None:
        named = found.withColumn("_canonical", F.col("_clash.property"))
    else:
        mapped = rules.where(F.col("canonical").isin(*key_fields)).groupBy(F.lower("native").alias("_native")).agg(F.min("canonical").alias("_canonical"))
        named = found.join(F.broadcast(mapped), "_native", "left")  # as many rows as a natural key has fields
    heals = F.coalesce(F.col("_canonical").isin(*key_fields) & ~F.col("_clash.holder").eqNullSafe(F.col("target_id")), F.lit(False))
    return named.select("source_id", F.when(heals, F.col("_clash.holder")).otherwise(F.col("target_id")).alias("target_id"), F.when(heals, "relinked").otherwise("error").alias("status"))


def conflicts(done: DataFrame) -> DataFrame:
    """The conflicts of a run, to be appended to their log: who won by which strategy."""
    return done.where(F.col("conflict")).select("source_id", "target_id", "strategy", "write_back")


def repointed(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links (source_id, target_id, keys) once records have been found: a link found by its key moves to the record that it was found for, and keys add up."""
    new = found.where(F.col("key").isNotNull()).select(F.col("source_id").alias("_new"), F.col("key").alias("_key"), F.col("link_id").alias("source_id"))
    taken = new.groupBy("source_id").agg(F.max("_new").alias("_new"), F.collect_set("_key").alias("_keys"))  # the records of one link
    joined = links.join(taken, "source_id", "left")
    keys = F.array_sort(F.array_union("keys", F.coalesce("_keys", F.array().cast("array<string>"))))
    return joined.select(F.coalesce("_new", "source_id").alias("source_id"), "target_id", keys.alias("keys"))


def present(records: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Records asked for by id, with null fields where there is none."""
    return ids.select(id_col).join(records, id_col, "left")


def read_back(source: DataFrame, links: DataFrame, target: DataFrame) -> DataFrame:
    """Per source id: whether it is there, linked, and its linked target there."""
    a = source.select(F.col("id").alias("source_id"))
    b = target.select(F.col("id").alias("target_id"), F.lit(True).alias("target_exists"))
    found = a.join(links.select("source_id", "target_id"), "source_id", "left").join(b, "target_id", "left")
    return found.select("source_id", F.col("target_id").isNotNull().alias("linked"), F.coalesce("target_exists", F.lit(False)).alias("target_exists"))


def edges_of(records: DataFrame, lookups: dict[str, str], id_col: str = "id") -> DataFrame:
    """Edges (from_id, to_id, kind) that the lookup columns of records hold; lists hold several."""
    array = lambda c: F.col(c) if records.schema[c].dataType.typeName() == "array" else F.array(F.col(c))
    named = lambda kind: lambda x: F.struct(x.cast("string").alias("to_id"), F.lit(kind).alias("kind"))
    pairs = F.flatten(F.array(*[F.transform(F.coalesce(array(c), F.array().cast("array<string>")), named(kind)) for c, kind in lookups.items()]))
    return records.select(F.col(id_col).alias("from_id"), F.inline(pairs)).where("to_id is not null")


def kept_deletions(gone: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """Deletions (id) seen for one type of a shared native object, without those that are linked as another type."""
    other = links.where(F.col("type") != kind).select(F.col("source_id").alias("id"))
    return gone.join(other, "id", "left_anti")


def associations(edges: DataFrame, from_links: DataFrame, to_links: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, kind) with both ends' counterparts; deferred where one has none yet."""
    a = from_links.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("from_target"))
    b = to_links.select(F.col("source_id").alias("to_id"), F.col("target_id").alias("to_target"))
    found = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    return found.withColumn("status", F.when(F.col("from_target").isNotNull() & F.col("to_target").isNotNull(), "synced").otherwise("deferred"))


def key_profile(df: DataFrame, key: Column) -> DataFrame:
    """Rows without a key, keys, and keys that several rows share, over the whole table."""
    counts = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(total(F.when(F.col("k").isNull(), F.col("n"))).alias("missing"), F.count("k").alias("n_keys"), F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("duplicate_keys"))


def links_wide(sides: DataFrame, systems: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows (link_id, system, native_id, hash) as one row for each link."""
    return sides.groupBy("link_id").pivot("system", list(systems)).agg(F.first("native_id").alias("id"), F.first("hash").alias("hash"))


def edges_upserted(held: DataFrame, new: DataFrame) -> DataFrame:
    """Stored edges (from_id, to_id, kind, label, at) with new ones laid over: one row for each key, a missing label being a key of its own; the newest counts."""
    both = held.unionByName(new).withColumn("label", F.coalesce("label", F.lit("")))
    keys = ["from_id", "to_id", "kind", "label"]
    return both.groupBy(*keys).agg(F.min("at").alias("first_at"), F.max("at").alias("at"))
