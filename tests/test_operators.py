"""Operators on literal rows, and the plan against a loop over records."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import jobs as J
from tandem.operators import predicates as P
from tandem.operators import quality as Q
from tandem.operators import reconcile as R
from tandem.operators import runs as U
from tandem.operators import settings as T
from tandem.sources import stores
from tandem.streaming import jobs as JS

FIELDS = ["email", "phone"]
RECORD = "id string, key string, email string, phone string, modified timestamp"
LINK = "source_id string, target_id string, target_hash string, source_hash string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("HTTPS://WWW.Example.com:80/x", "example.com"), ("example.com/a", "example.com"), ("", ""), (None, None), ("not a url", "not a url")])
def test_domain(spark, given, want):
    assert one(spark, S.domain(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize("given, want", [("5", 5.0), (" 0x10 ", 16.0), ("", None), (" ", 0.0), ("1d", None), ("NaN", None), ("Infinity", None), ("1e3", 1000.0), (None, None), ("-.5", -0.5)])
def test_number(spark, given, want):
    assert one(spark, S.number(F.lit(given).cast("string"))) == want


def test_small_transforms(spark):
    assert one(spark, S.js_trim(F.lit("\t\xa0a b﻿\n"))) == "a b"
    assert one(spark, S.phone(F.lit(" +1 (20) 3-4 "))) == "+12034"
    assert one(spark, S.iso_date(F.lit("2024-05-06"))) == "2024-05-06T00:00:00.000Z"
    assert one(spark, S.iso_date(F.lit("soon"))) == "soon"
    assert one(spark, S.epoch_millis(F.lit(1500), "number")) == "1970-01-01T00:00:01.500Z"
    assert one(spark, S.number_string(F.lit(1e7))) == "10000000"
    assert one(spark, S.backoff_millis(F.lit(100))) == 60000
    assert one(spark, S.slug(F.lit(" My  Object! "))) == "my_object"
    assert one(spark, S.plain_name(F.lit("Deal-Items"))) == "dealitem"
    assert one(spark, S.clamped_interval(F.lit(None).cast("int"))) == 30


def test_natural_key_needs_all_fields(spark):
    df = spark.createDataFrame([("A ", "x"), ("a", None), ("a", " ")], "name string, date string")
    assert [r.k for r in df.select(S.natural_key({"name": F.col("name"), "date": F.col("date")}).alias("k")).collect()] == ["name:a|date:x", None, None]


def test_conditions(spark):
    df = spark.createDataFrame([("1", None), ("x", "5"), (None, "Keep@co")], "a string, b string")
    hold = lambda *c: [r.a for r in df.where(P.matches(list(c), df)).collect()]
    assert hold() == ["1", "x", None]
    assert hold(P.Condition("b", "ne", "5")) == ["1", None]
    assert hold(P.Condition("a", "lt", 1)) == [None]
    assert hold(P.Condition("b", "contains", "KEEP")) == [None]
    assert hold(P.Condition("nowhere", "gt", 0)) == []
    with pytest.raises(ValueError):
        P.raw("1=1; DROP TABLE x")


def test_routing_drops_rows_of_no_type(spark):
    df = spark.createDataFrame([(True,), (False,)], "flag boolean")
    assert [(r.flag, r.type) for r in P.route(df, [("site", [P.Condition("flag", "eq", True)])]).collect()] == [(True, "site")]


def _random(rng, side, n):
    return [(f"{side}{i}", k, k and rng.choice([k, k.upper()]), rng.choice([None, "1", "2"]), None) for i in range(n) for k in [rng.choice([None, "p", "q", "r", "s", "t"])]]


def _looped(source, target, links):
    rows, by_id, out = {t[0]: t for t in target}, {x[0]: x for x in links}, {}
    for s in source:
        link = by_id.get(s[0])
        t = rows.get(link[1]) if link else None
        same = [x for x in target if s[1] and x[1] == s[1]]
        matched = False
        if t is None and len(same) > 1:
            out[s[0]] = ("ambiguous", None)
            continue
        if t is None and same:
            t, matched = same[0], True
        if t is None:
            out[s[0]] = ("create", None)
        elif s[2:4] == t[2:4]:
            out[s[0]] = ("skip", t[0])
        elif link and link[2] and not (link[2] == "current" and link[1] in rows):
            out[s[0]] = ("conflict", t[0])
        else:
            out[s[0]] = ("match" if matched and not link else "update", t[0])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_preview_is_what_a_loop_says(spark, seed):
    rng = random.Random(seed)
    source, target = _random(rng, "a", 30), _random(rng, "b", 12)
    links = [(f"a{i}", f"b{i + rng.choice([0, 0, 50])}", rng.choice(["current", "stale", ""]), None) for i in range(0, 12, 2)]
    t = spark.createDataFrame(target, RECORD)
    hashes = {r.id: r.hash for r in R.with_hash(t, FIELDS).collect()}
    given = spark.createDataFrame([(s, x, hashes.get(x, "gone") if h == "current" else h, z) for s, x, h, z in links], LINK)
    got = {r.source_id: (r.action, r.target_id) for r in R.preview(spark.createDataFrame(source, RECORD), t, given, FIELDS).collect()}
    want = _looped(source, target, links)
    assert got == want


def test_linked_by_key_when_no_id_link(spark):
    source = spark.createDataFrame([("a1", "p", "p", "1", None)], RECORD)
    target = spark.createDataFrame([("b1", None, "p", "1", None)], RECORD)
    links = spark.createDataFrame([("old", "b1", None, None, "p")], LINK + ", key string")
    assert [(r.action, r.target_id) for r in R.preview(source, target, links, FIELDS).collect()] == [("skip", "b1")]


def test_plans_after_applying_are_skips(spark):
    source = spark.createDataFrame([("a1", "p", "p", "1", None), ("a2", None, None, "2", None), ("a3", "q", "q", "3", None)], RECORD)
    target = spark.createDataFrame([("b3", "q", "Q", "9", None)], RECORD)
    links = spark.createDataFrame([], LINK)
    plans = R.preview(source, target, links, FIELDS)
    after = R.links_after(plans, source, links, FIELDS).withColumn("key", F.lit(None).cast("string"))
    written = source.join(after.select(F.col("source_id").alias("id"), "target_id"), "id").select(F.col("target_id").alias("id"), "key", *FIELDS, "modified")
    again = R.preview(source, stores.upserted(target, written, ["id"]), after.drop("key"), FIELDS)
    assert {r.action for r in again.collect()} == {"skip"}
    assert R.without_echoes(source, after, FIELDS).count() == 0


def test_resolution_of_missing_and_equal_sides(spark):
    shape = "source_id string, target_id string, a struct<email:string,modified:timestamp>, b struct<email:string,modified:timestamp>"
    df = spark.createDataFrame([("1", "1", ("x", None), ("y", None)), ("2", "2", None, ("y", None)), ("3", "3", ("x", None), None)], shape)
    assert [r.winner for r in R.resolve(df, ["email"], "last-write-wins").orderBy("source_id").collect()] == ["b", "b", "a"]


def test_stores(spark):
    store = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, 1), (3, "c", 2), (3, "d", 3)], "k int, v string, seq int")
    assert sorted(tuple(r) for r in stores.patched(store, new.where("seq < 3").drop("seq"), ["k"]).collect()) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert [tuple(r) for r in stores.inserted_if_absent(store, new, ["k"], F.col("seq")).collect()] == [(3, "c", 2)]
    assert [r.k for r in stores.deleted(store, new, ["k"]).collect()] == [1]
    assert {(r.k, r.n) for r in stores.added_up(store.select("k", F.lit(1).alias("n")), store.select("k", F.lit(2).alias("n")), ["k"], "n").collect()} == {(1, 3), (2, 3)}
    assert stores.schema_rows(store, "t").count() == 3


def test_empty_inputs(spark):
    none = spark.createDataFrame([], RECORD)
    assert R.preview(none, none, spark.createDataFrame([], LINK), FIELDS).count() == 0
    assert tuple(R.key_profile(none, F.col("key")).first()) == (0, 0, 0)
    assert J.stats(spark.createDataFrame([], "status string")).first().total == 0


def test_recovered_jobs(spark):
    jobs = spark.sql("SELECT 'processing' AS status, timestamp'2024-01-01' AS locked_at UNION ALL SELECT 'completed', timestamp'2024-01-01'")
    assert sorted(r.status for r in J.recovered(jobs, F.lit("2024-01-02").cast("timestamp")).collect()) == ["completed", "retry"]


# Transforms, by the kind of what comes in


@pytest.mark.parametrize(
    "name, given, want",
    [
        ("yes-no", "YES", True), ("yes-no", "1", True), ("yes-no", " yes ", False), ("yes-no", True, "yes"), ("yes-no", False, "no"), ("yes-no", 5, 5), ("true-false", "TRUE", True), ("true-false", " true", False), ("true-false", False, "false"),
        ("boolean", 5, True), ("boolean", 0, False), ("boolean", "5", False), ("boolean", True, True), ("number", True, 1.0), ("number", 2.5, 2.5), ("iso-date", 1500, "1970-01-01T00:00:01.500Z"), ("iso-date", "2024-05-06", "2024-05-06T00:00:00.000Z"),
        ("epoch-millis", 1500, "1970-01-01T00:00:01.500Z"), ("epoch-millis", "1970-01-01T00:00:01.500Z", 1500), ("lowercase", 7, 7), ("phone", True, True),
    ],
)
def test_transforms_go_by_kind(spark, name, given, want):
    df = spark.createDataFrame([(given,)], f"x {'string' if isinstance(given, str) else 'boolean' if isinstance(given, bool) else 'double' if isinstance(given, float) else 'long'}")
    assert df.select(S.TRANSFORMS[name](F.col("x"), S.kind_of(df.schema[0].dataType)).alias("y")).first().y == want


def test_dates_are_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, S.iso_date(F.lit("2024-05-06"))) == "2024-05-06T00:00:00.000Z"
        assert one(spark, S.iso_date(F.lit("2024-05-06T10:00:00Z"))) == "2024-05-06T10:00:00.000Z"
        assert one(spark, S.epoch_millis(F.lit(0), "number")) == "1970-01-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_numbers_hash_in_their_shortest_form_and_booleans_are_no_keys(spark):
    plain = one(spark, S.content_hash({"x": F.lit("10000000")}))
    assert one(spark, S.content_hash({"x": F.lit(1e7)}, {"x": "number"})) == plain
    assert one(spark, S.natural_key({"x": F.lit(5.0)}, {"x": "number"})) == "x:5" and one(spark, S.natural_key({"x": F.lit(True)}, {"x": "boolean"})) is None


def test_typed_conditions(spark):
    df = spark.createDataFrame([(True, 2), (False, 0), (None, None)], "flag boolean, n int")
    hold = lambda *c: [r.n for r in df.where(P.matches(list(c), df)).collect()]
    assert hold(P.Condition("flag", "gt", 0)) == [2] and hold(P.Condition("flag", "lt", 1)) == [0, None] and hold(P.Condition("n", "gt", None)) == [] and hold(P.Condition("n", "lt", None)) == []
    assert df.where(P.raw("n = 2 AND 'order by' <> 'limit'")).count() == 1
    with pytest.raises(ValueError):
        P.raw("n = 2 OR upsert")


# Reconciliation as a loop over records would do it


def test_links_move_to_the_record_that_was_found(spark):
    links = spark.createDataFrame([("old", "b1", None, None, ["o", "p"])], LINK + ", keys array<string>")
    moved = R.repointed(links, spark.createDataFrame([("a9", "p2", "old")], "source_id string, key string, link_id string")).first()
    assert tuple(moved) == ("a9", "b1", ["o", "p", "p2"])


def test_gates_refuse(spark):
    shape = "source string, source_id string, action string, target_id string, field_diff array<struct<field:string,source:string,target:string>>, warnings array<string>"
    of = lambda *rows: spark.createDataFrame([(s, i, a, None, [], []) for s, i, a in rows], shape)
    why = lambda frozen, now: U.gates(frozen, now).first().refused
    fine = of(("a", "1", "skip"))
    assert why(of(), fine) == "empty" and why(of(("a", "1", "ambiguous")), fine) == "ambiguous" and why(of(("a", "1", "skip"), ("b", "2", "skip")), fine) == "mixed_sources"
    assert why(fine, of(("a", "1", "update"))) == "drift" and why(fine, of()) == "drift" and why(fine, fine) is None


def test_schedules():
    monday = datetime.datetime(2024, 1, 1)
    assert T.cron_fields("*/2 * * * *") and T.cron_fields("0 9 * * 1") and not T.cron_fields("not a cron expression") and not T.cron_fields("") and not T.cron_fields("61 * * * *")
    assert T.next_times("0 9 * * 1", monday, 2) == [monday.replace(hour=9), monday.replace(day=8, hour=9)]
    assert T.next_times("0 0 13 * fri", monday, 2) == [datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 12)] and T.next_times("0 0 31 2 *", monday) == []


def test_job_signals_that_do_not_fit_change_nothing():
    step = lambda job, signal, at=1000: JS.moved(job, signal, at, "manual-review", 2)
    new = JS.Job()
    assert step(new, "claim") == new and step(new, "succeed") == new and step(new, "replay") == new
    job = step(new, "enqueue")
    assert step(job, "enqueue") == job and step(job, "fail") == job and step(job, "claim", 999) == job
    job = step(step(job, "claim"), "fail")
    assert job[:3] == ("retry", 1, 1500) and step(job, "claim", 1499) == job and step(job, "dismiss").status == "dismissed"
    job = step(step(job, "claim", 1500), "fail")
    assert job[:3] == ("dead_letter", 2, None) and step(job, "claim") == job
    assert step(job, "replay")[:3] == ("queued", 0, 1000) and step(job, "dismiss").status == "dismissed" and step(job, "approve") == job
    waits = JS.moved(JS.Job("processing", 1), "delete", 0)
    assert waits.status == "manual_review" and step(waits, "approve").status == "completed" and step(JS.Job("manual_review"), "approve").status == "manual_review"
    assert JS.moved(JS.Job("processing", 1), "delete", 0, "ignore").status == "completed" and JS.moved(JS.Job("completed", 3), "replay", 5)[:3] == ("queued", 0, 5)


def test_time_moves_jobs():
    assert JS.elapsed(JS.Job("retry", 1, 500), 499) == JS.Job("retry", 1, 500)
    assert JS.elapsed(JS.Job("retry", 1, 500), 500) == JS.Job("processing", 2, None, 500)
    assert JS.elapsed(JS.Job("queued", 0, 0), 2 * JS.LEASE + 1) == JS.Job("processing", 3, None, 2 * JS.LEASE)
    assert JS.elapsed(JS.Job("completed", 1), 10**12) == JS.Job("completed", 1) and JS.deadline(JS.Job("processing", 1, None, 7)) == 7 + JS.LEASE


def test_an_attempt_counts_once(spark):
    """Claimed and failed again and again, a job is given up after eight attempts."""
    jobs, n = spark.sql("SELECT 'k' AS event_key, 'e' AS event_id, 'queued' AS status, 0 AS attempts, timestamp'2024-01-01' AS created_at, timestamp'2024-01-01' AS next_attempt_at"), 0
    late = F.lit("2025-01-01").cast("timestamp")
    while jobs.first().status != "dead_letter":
        n += 1
        row = J.after_failure(J.claimed(jobs, late, 5), F.lit("2024-01-01").cast("timestamp")).collect()
        jobs = spark.createDataFrame([tuple(r) for r in row], "event_key string, event_id string, status string, attempts int, created_at timestamp, next_attempt_at timestamp")
    assert n == 8


def test_commands_see_what_earlier_ones_left(spark):
    jobs = spark.createDataFrame([("d", "deleted", "manual_review", 3), ("u", "updated", "manual_review", 3), ("r", "updated", "retry", 2)], "event_key string, change string, status string, attempts int")
    given = [("d", 2, "dismiss"), ("d", 1, "approve"), ("u", 1, "approve"), ("u", 2, "dismiss"), ("u", 3, "replay"), ("r", 1, "dismiss"), ("x", 1, "replay"), ("r", 2, None)]
    found = J.commanded(jobs, spark.createDataFrame(given, "event_key string, seq int, command string"))
    assert {tuple(r) for r in found.collect()} == {("d", "deleted", "completed", 3, 1), ("u", "updated", "queued", 0, 1), ("r", "updated", "dismissed", 2, 0)}


@pytest.mark.parametrize("given, want", [
    (0.0001, "0.0001"), (1e15, "1000000000000000"), (1e21, "1e+21"), (-0.0, "0"), (1e-6, "0.000001"), (1e-7, "1e-7"), (123456789012345680000.0, "123456789012345680000"), (0.1 + 0.2, "0.30000000000000004"), (-1.5e-9, "-1.5e-9"),
    (1.7976931348623157e308, "1.7976931348623157e+308"), (2e-3, "0.002"), (100.25, "100.25"), (float("inf"), "Infinity"), (float("nan"), "NaN"), (None, None), (9007199254740993.0, "9007199254740992"), (2.0**-44, "5.684341886080802e-14"),
])
def test_numbers_in_their_shortest_form(spark, given, want):
    assert one(spark, S.number_string(F.lit(given).cast("double"))) == want


def test_preflight_without_profiles(spark):
    rules = spark.createDataFrame([("b", "x", "x", None, None, False)], "system string, canonical string, native string, read string, write string, read_only boolean")
    schemas = spark.createDataFrame([("b", "x", "string", True, False, 0)], "system string, native string, type string, required boolean, read_only boolean, n_options int")
    assert [(r.code, r.system) for r in Q.preflight(rules, schemas, None, None).collect()] == [("NATURAL_KEY_PROFILE_UNAVAILABLE", None)]


def test_refused_conditions_on_odd_rows(spark):
    rows = [("a", "email", "eq", None), ("a", None, "eq", None), ("a", "f" * 201, "eq", None), ("a", "email", None, None), (None, "email", "eq", None), ("b", None, None, "x > 1"), ("a", None, None, "x > 1"), ("a", None, None, "updated > 1"), ("a", None, None, "1 /* */"), ("a", None, None, "x" * 501), ("a", None, None, "1 UNION 2")]
    df = spark.createDataFrame(rows, "system string, field string, operator string, raw string")
    found = [r.refused for r in P.refused_conditions(df, ["a", "b"]).collect()]
    assert found == [None, "field", "field", "operator", "unknown_system", "raw_not_supported", None, None, "unsafe_raw", "unsafe_raw", "unsafe_raw"]


def test_refused_plans_on_odd_rows(spark):
    rows = [(" p ", "a", ["x", "x"], None), (None, "a", ["x"], 1), ("p", "c", ["x"], 1), ("p", "a", None, 1), ("p", "a", ["x", None], 1), ("p", "a", ["y"], 1), ("p", "a", ["x"], 100_001), ("p", "a", ["x"], 100_000)]
    df = spark.createDataFrame(rows, "name string, source string, types array<string>, per_type int")
    found = U.refused_plans(df, ["a", "b"], ["x"]).collect()
    assert [r.refused for r in found] == [None, "name", "source", "types", "types", "types", "per_type", None]
    assert (found[0].name, found[0].types) == ("p", ["x"])


def test_poll_summary_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([("x", None, 2, "e"), ("x", 1, None, None)], "type string, changed int, deleted int, error string")
    assert {tuple(r) for r in U.poll_summary(df).collect()} == {("x", 1, 2, 1), (None, 1, 2, 1)}
    assert [tuple(r) for r in U.poll_summary(df.limit(0)).collect()] == [(None, 0, 0, 0)]


def test_searched_blank_finds_all_and_nulls_do_not_hide_a_row(spark):
    df = spark.createDataFrame([("Deal", None), (None, "Dealer"), ("x", "y")], "label string, target string")
    assert Q.searched(df, "  ", ["label", "target"]).count() == 3
    assert Q.searched(df, "DEAL", ["label", "target"]).count() == 2
    assert Q.searched(df, "x y", ["label", "target"]).count() == 1


def test_edges_upserted_keeps_one_row_a_key(spark):
    kind = "from_id string, to_id string, kind string, label string, at int"
    held, new = spark.createDataFrame([("a", "b", "k", None, 1)], kind), spark.createDataFrame([("a", "b", "k", "", 5), ("a", "b", "k", "l", 2)], kind)
    assert {(r.label, r.first_at, r["at"]) for r in R.edges_upserted(held, new).collect()} == {("", 1, 5), ("l", 2, 2)}


def test_with_setting_keeps_the_others(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, null]}, "n": 1}',), ("{}",), (None,)], "s string")
    found = [r.x for r in df.select(T.with_setting(F.col("s"), "n", F.lit('{"on": true}')).alias("x")).collect()]
    assert found == ['{"a":{"b":[1,null]},"n":{"on":true}}', '{"n":{"on":true}}', None]
