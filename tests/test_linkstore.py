"""The link store against a loop of upserts, and alerts that are told once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import linkstore
from tandem.sources import versions
from tandem.streaming import alerts

WRITE = "seq int, link_id string, type string, at timestamp, sides array<struct<system:string,native_id:string,content_hash:string,modified_at:timestamp>>, natural_keys array<string>"


@pytest.mark.parametrize("seed", range(2))
def test_writes_are_those_of_a_loop(spark, seed):
    rng = random.Random(seed)
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    writes = []
    for n in range(60):
        sides = [(s, rng.choice([None, "", f"{s}{rng.randrange(9)}"]), rng.choice([None, "h1", "h2"]), at(n)) for s in ("a", "b")]
        writes.append((n, f"l{rng.randrange(7)}", rng.choice(["contact", "deal"]), at(n), sides, rng.sample(["p", "q", "r", "s", None], 2)))
    held = ([("l0", "deal", at(-1)), ("old", "deal", at(-1))], [("l0", "a", "a-old", "h0", at(-1)), ("old", "b", "b-old", None, None)], [("deal", "p", "old"), ("deal", "z", "old")])
    links, sides, keys = {x[0]: x for x in held[0]}, {x[:2]: x for x in held[1]}, {x[:2]: x for x in held[2]}
    for seq, link, type_, moment, own, names in writes:
        links[link] = (link, type_, moment)
        sides |= {(link, s): (link, s, i, h, m) for s, i, h, m in own if i}
        keys |= {(type_, k): (type_, k, link) for k in names if k is not None}
    rng.shuffle(writes)
    given = [spark.createDataFrame(x, s) for x, s in zip(held, (linkstore.LINKS, linkstore.SIDES, linkstore.KEYS))]
    found = linkstore.written(*given, spark.createDataFrame(writes, WRITE))
    for df, want in zip(found, (links, sides, keys)):
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.values(), key=repr)
    twice = {}
    for link, system, native, *_ in sides.values():
        twice.setdefault((system, native), []).append(link)
    assert {tuple(r) for r in linkstore.clashes(found[1]).collect()} == {(*k, len(v)) for k, v in twice.items() if len(v) > 1}
    wide = {r.link_id: r for r in linkstore.found_by(*found).collect()}
    assert {i: r["keys"] for i, r in wide.items()} == {i: sorted({x[1] for x in keys.values() if x[2] == i}) for i in links}
    assert {i: r.source_id for i, r in wide.items() if r.source_id} == {x[0]: x[2] for x in sides.values() if x[1] == "a"}


def test_a_restart_alerts_nothing_twice(spark, tmp_path):
    jobs, told, heard = str(tmp_path / "jobs"), str(tmp_path / "told"), []
    add = lambda *rows: spark.createDataFrame(rows, "event_key string, status string, attempts int").coalesce(1).write.mode("append").parquet(jobs)
    tell = lambda digest, batch: heard.append(digest.first().n_alerts)
    read = lambda: spark.readStream.schema("event_key string, status string, attempts int").parquet(jobs)
    run = lambda log: alerts.told_once(read(), told, str(tmp_path / log), tell).awaitTermination()
    add(("j1", "dead_letter", 8), ("j1", "dead_letter", 8), ("j2", "completed", 1), ("j3", "manual_review", 1))
    run("log")
    run("log")
    add(("j1", "dead_letter", 8), ("j3", "manual_review", 2))
    run("log")
    run("another log")
    assert heard == [2, 1] and sorted(r.alert_key for r in versions.opened(spark, told).collect()) == ["j1:dead_letter:8", "j3:manual_review:1", "j3:manual_review:2"]


def test_routes_of_live_and_vanished_records(spark):
    changes = spark.createDataFrame([("e1", "a", "r1", "updated"), ("e2", "b", "r1", "updated"), ("e3", "a", "r2", "deleted"), ("e4", "a", "r3", "updated"), ("e5", "a", "r4", "updated")], "event_key string, system string, source_id string, change string")
    records = spark.createDataFrame([("r1", None, "x", "deal"), ("r2", "t", "x", "deal"), ("r3", None, None, "contact")], "id string, email string, title string, linked_type string")
    settings = spark.createDataFrame([("contact", "a_to_b", True), ("deal", "both", True)], "type string, direction string, enabled boolean")
    found = alerts.routed(changes, records, settings, [("contact", [alerts.Condition("title", "is_not_null")])])
    assert sorted((r.event_key, r.type) for r in found.collect()) == [("e1", "contact"), ("e3", "deal"), ("e4", "contact")]
    assert alerts.routed(changes, records, settings.withColumn("enabled", F.lit(False)), []).collect() == []
