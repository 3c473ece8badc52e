"""Carrying source records over to the other system, each one seeing what the records before it have left.

Most records meet nobody: their key, link and target are theirs alone, and a plan of joins settles them at once. Records that share a key, a
link or a target with others are settled in the order of their ids within the set of records that hang together, since the first
one's write decides what the second one finds: the link that it made, the hashes that it left, the target's new content. Such
sets are told by labels that spread over what is shared; each is then read as a sorted run of rows, holding in memory the links, keys and targets
that it touches but not its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tandem.functions.scalars import content_hash, text
from tandem.operators.reconcile import candidates, key_owners, spread
from tandem.sources.stores import saved

STRATEGIES = ("source-of-truth", "last-write-wins", "field-merge")


def attached(source: DataFrame, target: DataFrame, links: DataFrame, fields: list[str]) -> DataFrame:
    """Source records with what a lookup finds for each: its link by id, the link that owns its key, and the targets of its key.

    Columns: id, key, s (struct of fields and modified), own and by_key (structs link_id, source_id, target_id, source_hash, target_hash, keys),
    n_candidates, candidate_id, incoming (content hash).
    """
    empty = F.array().cast("array<string>")
    keys = F.col("keys") if "keys" in links.columns else F.array_compact(F.array("key")) if "key" in links.columns else empty
    hashed = F.col("source_hash") if "source_hash" in links.columns else F.lit(None).cast("string")
    number = F.col("link_id") if "link_id" in links.columns else F.col("source_id")
    link = F.struct(number.cast("string").alias("link_id"), "source_id", "target_id", hashed.alias("source_hash"), "target_hash", F.coalesce(keys, empty).alias("keys"))
    known = links.withColumn("_link", link)
    found = source.select("id", "key", F.struct(*fields, "modified").alias("s"), content_hash({f: F.col(f) for f in fields}).alias("incoming"))
    found = found.join(known.select(F.col("source_id").alias("id"), F.col("_link").alias("own")), "id", "left").withColumn("_key", spread("key"))
    found = found.join(key_owners(known, "_link").select(F.col("key").alias("_key"), F.col("_link").alias("by_key")), "_key", "left")
    found = found.join(candidates(target).withColumnRenamed("key", "_key"), "_key", "left")
    return found.drop("_key").withColumn("candidate_id", F.when(F.col("n_candidates") == 1, F.col("candidate_id")))


def _shared(found: DataFrame) -> DataFrame:
    """(id, token): what each record shares with another one: keys, links and targets."""
    named = lambda kind, c: F.concat(F.lit(kind), c)
    several = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: named(kind, x))
    ones = F.array(
        named("k", F.col("key")), named("l", F.col("own.link_id")), named("l", F.col("by_key.link_id")), named("t", F.col("own.target_id")), named("t", F.col("by_key.target_id")), named("t", F.col("candidate_id"))
    )
    tokens = found.select("id", F.explode(F.array_distinct(F.array_compact(F.concat(ones, several("k", F.col("own.keys")), several("k", F.col("by_key.keys")))))).alias("token"))
    crowded = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    return tokens.join(crowded, "token")


def _together(tokens: DataFrame) -> DataFrame:
    """(id, group): the smallest id of the records that hang together by tokens, spread from token to record until nothing changes."""
    tokens = saved(tokens, "carry-shared")
    labels = saved(tokens.select("id", F.col("id").alias("group")).distinct(), "carry-groups")
    while True:
        least = tokens.join(labels, "id").groupBy("token").agg(F.min("group").alias("group"))
        spread_on = saved(tokens.join(least, "token").groupBy("id").agg(F.min("group").alias("group")), "carry-groups")
        if not spread_on.join(labels.withColumnRenamed("group", "_before"), "id").where("group < _before").take(1):
            return spread_on
        labels = spread_on


def _settled_alone(found: DataFrame, target: DataFrame, fields: list[str], strategy: str, source_of_truth: str, owners: dict[str, str], required: list[str]) -> DataFrame:
    """The outcome of records that share nothing, as one plan."""
    link = F.coalesce("own", "by_key")
    found = found.withColumn("link", link).withColumn("target_id", F.when(link.isNotNull(), F.col("link.target_id")).otherwise(F.col("candidate_id")))
    rows = target.select(F.col("id").alias("_at"), F.struct(*fields, "modified").alias("t"))
    found = found.withColumn("_at", F.coalesce("target_id", F.concat(F.lit("\x01"), "id"))).join(rows, "_at", "left")
    of = lambda side: content_hash({f: F.col(f"{side}.{f}") for f in fields})
    echo = F.coalesce(F.col("link.source_hash") == F.col("incoming"), F.lit(False))
    vague = F.col("link").isNull() & (F.coalesce("n_candidates", F.lit(0)) > 1)
    conflict = F.col("t").isNotNull() & ~F.coalesce(F.col("link.target_hash") == of("t"), F.lit(False)) & ~echo & ~vague
    later = F.coalesce(F.col("s.modified") >= F.col("t.modified"), F.lit(False))
    winner = []
    for f in fields:
        s, t = F.col(f"s.{f}"), F.col(f"t.{f}")
        if strategy == "field-merge":
            mine = F.lit(owners[f] == "a") if f in owners else later
            picked = F.when(mine, F.coalesce(s, t)).otherwise(F.coalesce(t, s))
        else:
            picked = F.when(F.lit(source_of_truth == "a") if strategy == "source-of-truth" else later, s).otherwise(t)
        winner.append(F.when(F.col("conflict"), picked).otherwise(s).alias(f))
    found = found.withColumn("conflict", conflict).withColumn("w", F.struct(*winner)).withColumn("written", of("w"))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(text(F.col(f"w.{f}")), F.lit("")) == "", F.lit(f)) for f in required])) if required else F.array().cast("array<string>")
    status = F.when(echo, "echo").when(vague, "ambiguous").when(F.size(missing) > 0, "error").otherwise("written")
    found = found.withColumn("status", status)
    done = F.col("status") == "written"
    only = lambda c: F.when(done, c)
    back = F.col("conflict") & (F.col("written") != F.col("incoming"))
    how = F.when(F.col("own").isNotNull(), "id").when(F.col("by_key").isNotNull(), "key").when(F.col("candidate_id").isNotNull(), "candidate")
    return found.select(
        F.col("id").alias("source_id"), "status", only(F.when(F.col("target_id").isNotNull(), "update").otherwise("create")).alias("op"), only(F.coalesce("target_id", F.concat(F.lit("new-"), "id"))).alias("target_id"),
        only(F.col("conflict")).alias("conflict"), F.when(F.col("conflict") & (status != "echo"), F.lit(strategy)).alias("strategy"), only(back).alias("write_back"), *[only(F.col(f"w.{f}")).alias(f) for f in fields],
        only(F.when(back, F.col("written")).otherwise(F.col("incoming"))).alias("source_hash"), only(F.col("written")).alias("target_hash"), how.alias("linked_by"),
        only(F.coalesce("link.link_id", F.concat(F.lit("link-"), "id"))).alias("link_id"), F.when(F.col("status") == "error", missing).alias("missing"),
    )


class _Known:
    """What a set of records knows so far: links by number, link numbers by source id and by key, and targets by id."""

    def __init__(self) -> None:
        self.links: dict[str, dict] = {}
        self.by_id: dict[str, str | None] = {}
        self.by_key: dict[str, str | None] = {}
        self.targets: dict[str, dict] = {}

    def meet(self, row: dict) -> None:
        """Takes in what the stores hold for a record, where nothing newer is known."""
        for link in (row["own"], row["by_key"]):
            if link:
                self.links.setdefault(link["link_id"], link)
        for t in row["targets"] or ():
            self.targets.setdefault(t["id"], t)
        self.by_id.setdefault(row["id"], row["own"] and row["own"]["link_id"])
        if row["key"] is not None:
            self.by_key.setdefault(row["key"], row["by_key"] and row["by_key"]["link_id"])

    def link_for(self, row: dict) -> tuple[dict, str | None]:
        """The link by id, else by key, else a new one to the only candidate; and how it was found."""
        number = self.by_id[row["id"]]
        if number:
            return self.links[number], "id"
        number = self.by_key.get(row["key"]) if row["key"] is not None else None
        if number:
            link = self.links[number]
            return link | {"source_id": row["id"], "keys": [*link["keys"], *({row["key"]} - set(link["keys"]))]}, "key"
        keys = [] if row["key"] is None else [row["key"]]
        new = {"link_id": f"link-{row['id']}", "source_id": row["id"], "target_id": row["candidate_id"], "source_hash": None, "target_hash": None, "keys": keys}
        return new, "candidate" if row["candidate_id"] is not None else None

    def store(self, link: dict) -> None:
        """The newest link takes its source id and its keys."""
        before = self.links.get(link["link_id"])
        if before:
            self.by_id[before["source_id"]] = None
        self.links[link["link_id"]] = link
        self.by_id[link["source_id"]] = link["link_id"]
        self.by_key |= dict.fromkeys(link["keys"], link["link_id"])


def _plain(column: pa.Array) -> list:
    """The same as to_pylist, column by column instead of value by value."""
    if pa.types.is_struct(column.type):
        names, there = [f.name for f in column.type], column.is_valid().to_pylist()
        if not names:
            return column.to_pylist()
        return [dict(zip(names, row)) if ok else None for ok, row in zip(there, zip(*map(_plain, column.flatten())))]
    if pa.types.is_list(column.type):
        values, out, begin = _plain(column.flatten()), [], 0
        for n in pc.list_value_length(column).to_pylist():
            out.append(None if n is None else values[begin : begin + n])
            begin += n or 0
        return out
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def _hash(values: dict, names: list[str]) -> str:
    return hashlib.sha256("|".join(f"{f}={values[f]['x']}" for f in names).encode()).hexdigest()[:16]


def _settled_in_turn(found: DataFrame, target: DataFrame, fields: list[str], strategy: str, source_of_truth: str, owners: dict[str, str], required: list[str], at: Column, schema: StructType) -> DataFrame:
    """The outcome of records (with their group), one after the other within each group."""
    pairs = lambda prefix: F.struct(*[F.struct(F.col(f"{prefix}{f}").alias("v"), text(F.col(f"{prefix}{f}")).alias("x")).alias(f) for f in fields])
    rows = target.select(F.col("id").alias("_at"), F.struct("id", pairs("").alias("w"), "modified", content_hash({f: F.col(f) for f in fields}).alias("hash")).alias("_t"))
    asked = found.select("id", F.explode(F.array_distinct(F.array_compact(F.array("own.target_id", "by_key.target_id", "candidate_id")))).alias("_at"))
    held = asked.join(rows, "_at").groupBy("id").agg(F.collect_list("_t").alias("targets"))  # at most three a record
    found = found.join(held, "id", "left").select("group", "id", "key", pairs("s.").alias("w"), F.col("s.modified").alias("modified"), "incoming", "own", "by_key", "n_candidates", "candidate_id", "targets", at.alias("at"))
    names, out_names = sorted(fields), schema.names

    def winner_of(row: dict, t: dict) -> dict:
        later = row["modified"] is not None and t["modified"] is not None and row["modified"] >= t["modified"]
        if strategy != "field-merge":
            mine = source_of_truth == "a" if strategy == "source-of-truth" else later
            return row["w"] if mine else t["w"]
        picked = {}
        for f in fields:
            first, second = (row["w"][f], t["w"][f]) if (owners[f] == "a" if f in owners else later) else (t["w"][f], row["w"][f])
            picked[f] = second if first["v"] is None else first
        return picked

    def outcome(row: dict, known: _Known) -> dict:
        known.meet(row)
        link, how = known.link_for(row)
        out = dict.fromkeys(out_names) | {"source_id": row["id"], "linked_by": how}
        if link["source_hash"] is not None and link["source_hash"] == row["incoming"]:
            return out | {"status": "echo"}
        if how is None and (row["n_candidates"] or 0) > 1:
            return out | {"status": "ambiguous"}
        t = known.targets.get(link["target_id"])
        conflict = bool(t) and t["hash"] != link["target_hash"]
        won = winner_of(row, t) if conflict else row["w"]
        out |= {"strategy": strategy if conflict else None}
        missing = [f for f in required if not won[f]["x"]]
        if missing:
            return out | {"status": "error", "missing": missing}
        at_target = link["target_id"] or f"new-{row['id']}"
        written = _hash(won, names)
        back = conflict and written != row["incoming"]
        known.targets[at_target] = {"id": at_target, "w": won, "modified": row["at"], "hash": written}
        known.store(link | {"target_id": at_target, "target_hash": written, "source_hash": written if back else row["incoming"]})
        return out | {
            "status": "written", "op": "update" if link["target_id"] else "create", "target_id": at_target, "conflict": conflict, "write_back": back,
            "source_hash": written if back else row["incoming"], "target_hash": written, "link_id": link["link_id"],
        } | {f: won[f]["v"] for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = None, _Known()
        for batch in batches:
            done = []
            for row in map(dict, map(zip, repeat(batch.schema.names), zip(*map(_plain, batch.columns)))):
                if row["group"] != group:
                    group, known = row["group"], _Known()
                done.append(outcome(row, known))
            columns = [pa.array([r[c] for r in done], arrow.field(c).type) for c in out_names]
            yield pa.RecordBatch.from_arrays(columns, names=out_names)

    arrow = to_arrow_schema(schema)
    return found.repartition("group").sortWithinPartitions("group", "id").mapInArrow(run, schema)


def reconciled(
    source: DataFrame, target: DataFrame, links: DataFrame, fields: list[str], strategy: str = "last-write-wins", source_of_truth: str = "a", owners: dict[str, str] | None = None,
    required: list[str] | None = None, at: Column | None = None,
) -> DataFrame:
    """What becomes of each source record (of system a) when all are carried over to b, in the order of their ids.

    A record uses its link by id, else the link that owns its key (which moves to the record), else a new one to the only target of its key. status:
    echo (what was last written to its link), ambiguous (several targets, no link), error (a required field would be written blank; missing
    names them), else written. A target that is not as its link left it makes a conflict, which the strategy resolves; field owners count under field-merge.
    op is create or update; the fields are the winner's; write_back tells that they differ from the source and go back there too; source_hash and
    target_hash are the link's new ones. Targets written here count as modified at a moment (now, if it is not given). Which targets a key
    has is told by the target as it was before. Null keys meet nothing; source ids are taken to be unique.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    owners, required = owners or {}, required or []
    found = saved(attached(source, target, links, fields), "carry-found")
    groups = _together(_shared(found))
    alone = _settled_alone(found.join(groups, "id", "left_anti"), target, fields, strategy, source_of_truth, owners, required)
    in_turn = _settled_in_turn(found.join(groups, "id"), target, fields, strategy, source_of_truth, owners, required, F.current_timestamp() if at is None else at, alone.schema)
    return alone.unionByName(in_turn)


def links_carried(links: DataFrame, done: DataFrame, source: DataFrame, order: str = "source_id") -> DataFrame:
    """Links (link_id, source_id, target_id, source_hash, target_hash, keys) once records have been carried: of the records of one link the last one counts, and keys add up."""
    last = done.where(F.col("status") == "written").join(source.select(F.col("id").alias("source_id"), "key"), "source_id")
    keys = F.array_compact(F.collect_set(F.when(~F.coalesce(F.col("linked_by") == "id", F.lit(False)), F.col("key"))))
    latest = last.groupBy("link_id").agg(F.max_by(F.struct("source_id", "target_id", "source_hash", "target_hash"), order).alias("n"), keys.alias("_keys"))
    joined = links.select(F.col("link_id").cast("string").alias("link_id"), F.struct("source_id", "target_id", "source_hash", "target_hash").alias("o"), "keys").join(latest, "link_id", "full")
    now = F.coalesce("n", "o")
    none = F.array().cast("array<string>")
    return joined.select("link_id", *[now[c].alias(c) for c in ("source_id", "target_id", "source_hash", "target_hash")], F.array_sort(F.array_union(F.coalesce("keys", none), F.coalesce("_keys", none))).alias("keys"))
