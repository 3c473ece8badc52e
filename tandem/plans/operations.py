"""More registered queries: carrying plans out, runs, settings, sources, errors and job states."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import carry as C
from tandem.operators import jobs as J
from tandem.operators import mapping as M
from tandem.operators import predicates as P
from tandem.operators import quality as Q
from tandem.operators import reconcile as R
from tandem.operators import runs as U
from tandem.operators import settings as T
from tandem.plans import fixtures as X
from tandem.plans.catalog import _META, _checkpoint, _plans, _query
from tandem.sources import discovery as D
from tandem.sources import stores
from tandem.streaming import events as E
from tandem.streaming import jobs as JS

# Transforms by the kind of what comes in


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS written, event_id % 2 = 0 AS back FROM events")
def transform_yes_no_write(spark: SparkSession, d: str) -> DataFrame:
    flags = stores.read(spark, d, "events", ["event_id"]).select(F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("flag"))
    rules = [M.FieldRule("flag", "written", "yes-no", "yes-no")]
    out = M.from_canonical(flags, rules)
    return out.join(M.to_canonical(out, rules).withColumnRenamed("flag", "back"), "id").withColumnRenamed("id", "event_id")


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS written, event_id % 2 = 0 AS back FROM events")
def transform_true_false_write(spark: SparkSession, d: str) -> DataFrame:
    flags = stores.read(spark, d, "events", ["event_id"]).select(F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("flag"))
    rules = [M.FieldRule("flag", "written", "true-false", "true-false")]
    out = M.from_canonical(flags, rules)
    return out.join(M.to_canonical(out, rules).withColumnRenamed("flag", "back"), "id").withColumnRenamed("id", "event_id")


@_query("SELECT event_id AS id, event_id % 3 <> 0 AS flag, (event_id % 2)::DOUBLE AS n, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS from_millis, epoch_ms(ts::DATE::TIMESTAMP) AS day FROM events")
def transform_typed(spark: SparkSession, d: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    e = stores.read(spark, d, "events", ["event_id", "ts"]).select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("Flag"), (F.col("event_id") % 2 == 1).alias("N"), millis.alias("Iso"), F.date_format("ts", "yyyy-MM-dd").alias("Day"))
    return M.to_canonical(e, [M.FieldRule("flag", "Flag", "boolean"), M.FieldRule("n", "N", "number"), M.FieldRule("iso", "Iso", "iso-date"), M.FieldRule("from_millis", "Iso", "epoch-millis"), M.FieldRule("day", "Day", "epoch-millis")])


@_query("SELECT o_orderkey, left(sha256('amount=' || floor(o_totalprice)::BIGINT || '|half=' || o_orderkey || '.5|note='), 16) AS hash FROM orders")
def content_hash_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = stores.read(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    fields = {"half": F.col("o_orderkey") + 0.5, "amount": F.floor("o_totalprice").cast("double"), "note": F.lit(None)}
    return o.select("o_orderkey", S.content_hash(fields, {"half": "number", "amount": "number"}).alias("hash"))


@_query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE '' END AS sign, rtrim(o_orderkey::VARCHAR, '0') AS digits, length(o_orderkey::VARCHAR) + o_orderkey % 40 - 18 AS n FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '0' ELSE sign || CASE WHEN n > 21 OR n < -5 THEN left(digits, 1) || CASE WHEN length(digits) > 1 THEN '.' || substr(digits, 2) ELSE '' END || CASE WHEN n > 0 THEN 'e+' ELSE 'e-' END || abs(n - 1) WHEN n <= 0 THEN '0.' || repeat('0', -n) || digits
  WHEN length(digits) <= n THEN digits || repeat('0', n - length(digits)) ELSE left(digits, n) || '.' || substr(digits, n + 1) END END AS shown FROM n""")
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of all sizes from 1e-18 to 1e27, in their shortest form."""
    key = F.col("o_orderkey")
    value = F.concat(F.when(key % 5 == 0, "-").otherwise(""), key.cast("string"), F.lit("e"), (key % 40 - 18).cast("string")).cast("double")
    return stores.read(spark, d, "orders", ["o_orderkey"]).select("o_orderkey", S.number_string(value).alias("shown"))


@_query("SELECT event_id, event_id % 3 = 1 AS more, event_id % 3 = 0 AS less FROM events")
def cond_typed(spark: SparkSession, d: str) -> DataFrame:
    e = stores.read(spark, d, "events", ["event_id"]).withColumn("flag", F.when(F.col("event_id") % 3 == 1, True).when(F.col("event_id") % 3 == 2, False)).withColumn("n", F.col("event_id") % 3)
    more = P.matches([P.Condition("flag", "gt", 0.5)], e)
    return e.select("event_id", more.alias("more"), (P.matches([P.Condition("n", "lt", True)], e) & ~P.matches([P.Condition("n", "gt", None)], e)).alias("less"))


# Carrying plans out

_DONE = X.SQL + """
, keyed AS (SELECT key, count(*) AS n, min(id) AS one FROM b WHERE key IS NOT NULL GROUP BY key),
lk AS (SELECT source_id, target_id, CASE WHEN a.k % 7 = 0 THEN l.source_hash ELSE 'old' END AS source_hash, target_hash FROM l JOIN a ON a.id = l.source_id),
j AS (SELECT ah.id AS source_id, ah.k, ah.key, ah.email, ah.phone, ah.title, ah.modified, ah.hash AS incoming, lk.target_id AS linked, lk.source_hash AS last_source, lk.target_hash AS last_target, keyed.n, keyed.one
    FROM ah LEFT JOIN lk ON lk.source_id = ah.id LEFT JOIN keyed ON keyed.key = ah.key),
t AS (SELECT j.*, coalesce(linked, CASE WHEN linked IS NULL AND n = 1 THEN one END) AS target FROM j),
w AS (SELECT t.*, bh.id AS read_id, bh.email AS e2, bh.phone AS p2, bh.title AS t2, bh.modified AS m2, bh.hash AS now_hash,
    CASE WHEN last_source = incoming THEN 'echo' WHEN linked IS NULL AND n > 1 THEN 'ambiguous' ELSE 'written' END AS status FROM t LEFT JOIN bh ON bh.id = t.target),
c AS (SELECT *, status = 'written' AND read_id IS NOT NULL AND last_target IS DISTINCT FROM now_hash AS clash FROM w),
v AS (SELECT *, CASE WHEN clash THEN CASE WHEN modified >= m2 THEN coalesce(email, e2) ELSE coalesce(e2, email) END ELSE email END AS we, CASE WHEN clash THEN coalesce(p2, phone) ELSE phone END AS wp,
    CASE WHEN clash THEN CASE WHEN modified >= m2 THEN coalesce(title, t2) ELSE coalesce(t2, title) END ELSE title END AS wt FROM c),
x AS (SELECT *, left(sha256('email=' || coalesce(we, '') || '|phone=' || coalesce(wp, '') || '|title=' || coalesce(wt, '')), 16) AS out_hash FROM v),
done AS (SELECT source_id, status, CASE WHEN status = 'written' THEN CASE WHEN target IS NULL THEN 'create' ELSE 'update' END END AS op, CASE WHEN status = 'written' THEN coalesce(target, 'new-' || source_id) END AS target_id,
    CASE WHEN status = 'written' THEN clash END AS conflict, CASE WHEN status = 'written' THEN clash AND out_hash <> incoming END AS write_back,
    CASE WHEN status = 'written' THEN wp END AS phone, CASE WHEN status = 'written' THEN out_hash END AS target_hash FROM x) """


def _done(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.expr("CAST(replace(source_id, 'a-', '') AS BIGINT) % 7 = 0"), F.col("source_hash")).otherwise("old")
    return C.reconciled(X.contact_a(spark, d), X.contact_b(spark, d), X.links(spark, d).withColumn("source_hash", old), X.FIELDS, "field-merge", owners={"phone": "b"})


@_query(_DONE + "SELECT * FROM done")
def reconcile_write_set(spark: SparkSession, d: str) -> DataFrame:
    return _done(spark, d).select("source_id", "status", "op", "target_id", "conflict", "write_back", "phone", "target_hash")


@_query(_DONE + "SELECT source_id, target_id, 'field-merge' AS strategy, write_back FROM done WHERE conflict")
def conflict_log(spark: SparkSession, d: str) -> DataFrame:
    return R.conflicts(_done(spark, d))


@_query(X.SQL + "SELECT CASE WHEN a.k % 4 = 0 THEN 'z-' || a.k ELSE l.source_id END AS source_id, target_id, concat_ws(',', 'email:' || a.k, CASE WHEN a.k % 4 = 0 THEN 'mail:' || a.k END) AS keys FROM l JOIN a ON a.id = l.source_id")
def links_repointed(spark: SparkSession, d: str) -> DataFrame:
    k = F.expr("replace(source_id, 'a-', '')")
    links = X.links(spark, d).withColumn("keys", F.array(F.concat(F.lit("email:"), k)))
    found = links.where(k.cast("long") % 4 == 0).select(F.concat(F.lit("z-"), k).alias("source_id"), F.concat(F.lit("mail:"), k).alias("key"), F.col("source_id").alias("link_id"))
    return R.repointed(links, found).select("source_id", "target_id", F.array_join("keys", ",").alias("keys"))


@_query(X.SQL + "SELECT l.source_id AS id, a.phone FROM l LEFT JOIN a ON a.id = l.source_id AND a.k % 3 <> 0")
def record_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = X.links(spark, d).select(F.col("source_id").alias("id"))
    return R.present(X.contact_a(spark, d).where("k % 3 <> 0").select("id", "phone"), asked)


@_query(X.SQL + "SELECT a.id AS source_id, l.target_id IS NOT NULL AS linked, coalesce(b.k % 3 <> 0, false) AS target_exists FROM a LEFT JOIN l ON l.source_id = a.id LEFT JOIN b ON b.id = l.target_id")
def canary_read_back(spark: SparkSession, d: str) -> DataFrame:
    return R.read_back(X.contact_a(spark, d), X.links(spark, d), X.contact_b(spark, d).where("k % 3 <> 0"))


@_query("SELECT 'd-' || o_orderkey AS from_id, 'a-' || o_custkey AS to_id, 'deal_contact' AS kind FROM orders UNION ALL SELECT 'd-' || o_orderkey, 'c-' || o_orderkey % 7, 'deal_company' FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'd-' || o_orderkey, 'c-' || (o_orderkey % 7 + 1), 'deal_company' FROM orders WHERE o_orderkey % 7 <> 0")
def lookup_edges(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    company = lambda n: F.concat(F.lit("c-"), (key % 7 + n).cast("string"))
    deals = stores.read(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(F.concat(F.lit("d-"), key.cast("string")).alias("id"), F.concat(F.lit("a-"), F.col("o_custkey").cast("string")).alias("contact"), F.when(key % 7 != 0, F.array(company(0), company(1))).alias("companies"))
    return R.edges_of(deals, {"contact": "deal_contact", "companies": "deal_company"})


@_query(X.SQL + "SELECT id FROM a WHERE NOT (k % 2 = 0 AND EXISTS (FROM l WHERE l.source_id = a.id))")
def shared_deletions(spark: SparkSession, d: str) -> DataFrame:
    even = F.expr("CAST(replace(source_id, 'a-', '') AS BIGINT) % 2 = 0")
    return R.kept_deletions(X.contact_a(spark, d).select("id"), X.links(spark, d).withColumn("type", F.when(even, "company").otherwise("contact")), "contact")


# Runs

def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    failed = X.contact_a(spark, d).where("k % 9 = 1").select(F.col("id").alias("source_id"), F.lit("refused").alias("message"))
    return U.outcomes(_plans(spark, d).withColumn("type", F.lit("contact")), failed)


@_query(X.SQL + X.PLANS + ", o AS (SELECT CASE WHEN action = 'ambiguous' OR CAST(replace(source_id, 'a-', '') AS BIGINT) % 9 = 1 THEN 'error' ELSE action END AS action FROM p), s AS (SELECT count(*) AS read, count(*) FILTER (action <> 'error') AS reconciled, count(*) FILTER (action = 'create') AS \"create\", count(*) FILTER (action = 'update') AS \"update\", count(*) FILTER (action = 'match') AS \"match\", count(*) FILTER (action = 'skip') AS skip, count(*) FILTER (action = 'conflict') AS conflict, 0::BIGINT AS ambiguous, count(*) FILTER (action = 'error') AS error FROM o) SELECT 'contact' AS type, * FROM s UNION ALL SELECT NULL, * FROM s")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return U.report(_outcomes(spark, d))


@_query(X.SQL + X.PLANS + "SELECT source_id, CASE WHEN action = 'ambiguous' THEN n || ' target records share this natural key' ELSE 'refused' END AS message FROM p WHERE action = 'ambiguous' OR CAST(replace(source_id, 'a-', '') AS BIGINT) % 9 = 1")
def run_errors(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).where("action = 'error'").select("source_id", F.element_at("warnings", -1).alias("message"))


@_query(X.SQL + X.PLANS + ", f AS (SELECT *, CAST(replace(source_id, 'a-', '') AS BIGINT) AS k FROM p WHERE action <> 'ambiguous') SELECT count(*) AS plans, 0::BIGINT AS ambiguous, 1::BIGINT AS sources, count(*) FILTER (k % 30 = 0 OR k % 31 = 0) AS drifted, count(*) FILTER (k % 31 = 0) AS gone, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (k % 30 = 0 OR k % 31 = 0) > 0 THEN 'drift' END AS refused FROM f")
def execute_gates(spark: SparkSession, d: str) -> DataFrame:
    frozen = _plans(spark, d).where("action <> 'ambiguous'").withColumn("source", F.lit("a"))
    changed = X.contact_a(spark, d).where("k % 31 <> 0").withColumn("title", F.when(F.col("k") % 30 == 0, "CHANGED").otherwise(F.col("title")))
    return U.gates(frozen, R.preview(changed, X.contact_b(spark, d), X.links(spark, d), X.FIELDS))


_PLAN_CASES = "SELECT o_orderkey AS plan_id, (o_orderkey % 3)::INTEGER AS revision, o_orderkey % 5 <> 0 AS verified, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 3)::INTEGER END AS canary_revision, (o_orderkey % 2)::INTEGER AS preview_revision, o_orderkey % 6 AS errors, o_orderkey % 100 AS records FROM orders"


def _plan_cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return stores.read(spark, d, "orders", ["o_orderkey"]).select(k.alias("plan_id"), (k % 3).cast("int").alias("revision"), (k % 5 != 0).alias("verified"), F.when(k % 4 != 0, (k % 3).cast("int")).alias("canary_revision"), (k % 2).cast("int").alias("preview_revision"), (k % 6).alias("errors"), (k % 100).alias("records"))


@_query(f"WITH c AS ({_PLAN_CASES}) SELECT plan_id, CASE WHEN NOT verified OR canary_revision IS DISTINCT FROM revision THEN 'verified_test_record_required' WHEN preview_revision <> revision THEN 'fresh_preview_required' WHEN errors > 0 THEN 'preflight_failed' WHEN plan_id % 7 = 0 THEN 'schema_changed_since_preview' WHEN plan_id % 3 <> 0 AND 950 + records > 1000 THEN 'plan_limit_exceeded' END AS refused FROM c")
def plan_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("plan_id")
    cases = _plan_cases(spark, d).withColumns({"schema_hash": F.lit("h"), "planned_hash": F.when(k % 7 == 0, "g").otherwise("h"), "used": F.lit(950), "most": F.when(k % 3 != 0, 1000)})
    return U.allowed(cases).select("plan_id", "refused")


@_query(f"WITH c AS ({_PLAN_CASES}) SELECT plan_id, (revision + (plan_id % 11 % 3 = revision)::INTEGER)::INTEGER AS revision, CASE WHEN plan_id % 11 % 3 <> revision THEN preview_revision END AS preview_revision, CASE WHEN plan_id % 11 % 3 <> revision THEN canary_revision END AS canary_revision FROM c")
def plan_revisions(spark: SparkSession, d: str) -> DataFrame:
    plans = _plan_cases(spark, d).select("plan_id", "revision", "preview_revision", "canary_revision")
    return U.edited(plans, plans.select("plan_id", (F.col("plan_id") % 11 % 3).cast("int").alias("base_revision")))


@_query("SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, CASE o_orderstatus WHEN 'P' THEN 'stopped' END AS message FROM orders")
def run_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    o = stores.read(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    change = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "fail")
    row = lambda at, change, message: o.select(F.col("o_orderkey").alias("run_id"), F.timestamp_add("DAY", at, F.col("o_orderdate")).alias("at"), change.alias("change"), message.alias("message"))
    ends = row(F.lit(2), change, F.when(F.col("o_orderstatus") == "P", "stopped")).where("change is not null")
    early = row(F.lit(1), F.lit("fail"), F.lit("first try")).where("run_id % 2 = 0").join(ends.select("run_id"), "run_id", "left_semi")
    return U.lifecycle(row(F.lit(0), F.lit("begin"), F.lit(None).cast("string")).unionByName(ends).unionByName(early)).select("run_id", "status", "message")


@_query(X.SQL + X.PLANS + "SELECT source_id, action, (SELECT count(*) > 50 FROM p) AS truncated FROM p ORDER BY source_id LIMIT 50")
def plan_page(spark: SparkSession, d: str) -> DataFrame:
    return U.ordered(_plans(spark, d).withColumn("type", F.lit("contact")), 50).select("source_id", "action", "truncated")


@_query(X.SQL + X.PLANS + "SELECT source_id, action FROM p WHERE source_id = 'a-12'")
def preview_record(spark: SparkSession, d: str) -> DataFrame:
    one = X.contact_a(spark, d).where(F.col("id") == "a-12")
    return R.preview(one, X.contact_b(spark, d), X.links(spark, d), X.FIELDS).select("source_id", "action")


@_query("SELECT event_type AS kind, count(*) AS n, NULL::VARCHAR AS metric FROM events WHERE event_type <> 'signup' GROUP BY 1 UNION ALL SELECT 'sync', count(*), 'records_synced' FROM events WHERE event_type = 'signup' HAVING count(*) > 0")
def activity_usage(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "sync").otherwise(F.col("event_type"))
    return U.activity_counts(stores.read(spark, d, "events", ["event_type"]).select(kind.alias("kind")))


@_query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def activity_newest(spark: SparkSession, d: str) -> DataFrame:
    return U.newest(stores.read(spark, d, "events", ["event_id", "ts"]).select(F.col("event_id").alias("id"), F.col("ts").alias("at"))).select("id")


@_query("WITH " + X.EVENTS + """
SELECT event_id AS job_id, CASE WHEN event_id % 4 = 0 THEN 'ignore' WHEN event_id % 3 = 0 THEN 'cascade' ELSE 'manual-review' END AS policy,
  CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 OR event_id % 11 = 0 AND event_id % 7 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN event_id % 5 = 0 OR event_id % 11 = 0 AND event_id % 7 = 0 THEN 'u' || event_id % 2 END AS reviewed_by
FROM jobs WHERE change = 'deleted'""")
def deletion_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of which one in eleven was there before; some are asked for again with another policy, some completed, and some completed before they were asked for."""
    gone = X.change_events(stores.read(spark, d, "events")).where("change = 'deleted'").select(F.col("event_id").alias("job_id"))
    k = F.col("job_id")
    policy, actor = F.when(k % 3 == 0, "cascade").otherwise("manual-review"), F.concat(F.lit("u"), (k % 2).cast("string"))
    step = lambda n, name, which: gone.where(which).select("job_id", F.lit(n).alias("seq"), F.lit(name).alias("step"), F.when(F.lit(n) == 3, "ignore").otherwise(policy).alias("policy"), actor.alias("actor"))
    steps = step(0, "completed", k % 7 == 0).unionByName(step(1, "asked", k % 11 != 0)).unionByName(step(2, "completed", k % 5 == 0)).unionByName(step(3, "asked", k % 4 == 0))
    held = gone.where(k % 11 == 0).select("job_id", policy.alias("policy"), F.when(k % 3 == 0, "completed").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("reviewed_by"))
    return U.deletion_requests(held, steps)


@_query("SELECT type, count(*) AS n FROM (SELECT 'contact' AS type FROM customer UNION ALL SELECT 'company' FROM supplier UNION ALL SELECT 'deal' FROM orders) GROUP BY type UNION ALL SELECT NULL, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders)")
def records_by_type(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t, kind: stores.read(spark, d, t).select(F.lit(kind).alias("type"))
    return of("customer", "contact").union(of("supplier", "company")).union(of("orders", "deal")).rollup("type").agg(F.count("*").alias("n"))


# Settings

@_query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER - 1 AS sort_order FROM part")
def rule_positions(spark: SparkSession, d: str) -> DataFrame:
    return T.positioned(stores.read(spark, d, "part", ["p_brand", "p_partkey"]), "p_brand", "p_partkey")


#: Schedules of customers: daily, weekly or none that can be read, or an interval.
_SCHEDULES = """
WITH s AS (SELECT c_custkey AS k, c_custkey % 5 <> 4 AS enabled, TIMESTAMP '2024-01-05 18:02:30' AS now FROM customer),
n AS (SELECT k, enabled, now, CASE k % 4 WHEN 0 THEN now::DATE + to_hours((k % 24)::INTEGER) + to_minutes((k % 60)::INTEGER) + to_days(CASE WHEN now::DATE + to_hours((k % 24)::INTEGER) + to_minutes((k % 60)::INTEGER) > now THEN 0 ELSE 1 END)
    WHEN 1 THEN now::DATE + to_hours(9) + to_days(CASE WHEN k % 7 = 5 THEN 7 ELSE ((k % 7 + 2) % 7)::INTEGER END)
    ELSE now + to_minutes(CASE WHEN k % 3 = 0 THEN 30 ELSE least(43200, greatest(1, k * 29)) END::INTEGER) END AS next_due_at FROM s)
"""


def _schedules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    daily, weekly = F.concat_ws(" ", (k % 60).cast("string"), (k % 24).cast("string"), F.lit("* * *")), F.concat(F.lit("0 9 * * "), (k % 7).cast("string"))
    rows = stores.read(spark, d, "customer", ["c_custkey"]).select(k.alias("k"), (k % 5 != 4).alias("enabled"), F.when(k % 4 == 0, daily).when(k % 4 == 1, weekly).when(k % 4 == 2, "not one").alias("cron"), F.when(k % 3 != 0, k * 29).alias("interval_minutes"))
    return T.next_due(rows, datetime(2024, 1, 5, 18, 2, 30))


@_query(_SCHEDULES + "SELECT k, next_due_at FROM n")
def schedule_next(spark: SparkSession, d: str) -> DataFrame:
    return _schedules(spark, d).select("k", "next_due_at")


@_query(_SCHEDULES + "SELECT k FROM n WHERE enabled AND next_due_at <= TIMESTAMP '2024-01-06 19:00:00'")
def schedule_due(spark: SparkSession, d: str) -> DataFrame:
    return T.due(_schedules(spark, d), datetime(2024, 1, 6, 19, 0)).select("k")


@_query("SELECT n_nationkey AS tenant, CASE WHEN n_nationkey % 3 = 0 THEN 'team' ELSE n_name END AS plan, CASE WHEN n_nationkey % 3 = 0 THEN 'active' ELSE 'none' END AS status, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS members FROM nation")
def tenant_overview(spark: SparkSession, d: str) -> DataFrame:
    n = stores.read(spark, d, "nation")
    tenants, held = n.select(F.col("n_nationkey").alias("tenant"), F.col("n_name").alias("plan")), n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("tenant"), F.lit("team").alias("plan"), F.lit("active").alias("status"))
    return T.overview(tenants, held, stores.read(spark, d, "customer", ["c_nationkey"]).select(F.col("c_nationkey").alias("tenant")))


@_query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def tenant_rows(spark: SparkSession, d: str) -> DataFrame:
    return T.of_tenant(stores.read(spark, d, "customer").withColumnRenamed("c_nationkey", "tenant"), 3).select("c_custkey")


@_query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'company,person' WHEN user_id % 3 = 0 THEN 'deal' END AS types, user_id % 2 = 0 AS shared FROM events")
def shared_types(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("a", "Account", "person"), ("a", "Account", "company"), ("a", "Deal", "deal"), ("b", "Account", "x")], "system string, native string, type string")
    native = F.when(F.col("user_id") % 2 == 0, "Account").when(F.col("user_id") % 3 == 0, "Deal").otherwise("Other")
    rows = stores.read(spark, d, "events", ["event_id", "user_id"]).select("event_id", F.lit("a").alias("system"), native.alias("native"))
    return T.by_native(registry, rows).select("event_id", F.array_join("types", ",").alias("types"), "shared")


# Errors, keys and findings


@_query(X.SQL + "SELECT id AS source_id, CASE k % 4 WHEN 3 THEN NULL WHEN 1 THEN 'phone' ELSE 'email' END AS property, CASE WHEN k % 4 <> 3 THEN 'v' || k END AS value, CASE k % 4 WHEN 3 THEN NULL WHEN 2 THEN 'b-' || k ELSE 'x-' || k END AS holder FROM a")
def duplicate_errors(spark: SparkSession, d: str) -> DataFrame:
    from tandem.plans.catalog import _refused

    clash = S.duplicate_conflict(S.vendor_message(F.col("body")))
    return _refused(spark, d).select("source_id", clash["property"].alias("property"), clash["value"].alias("value"), clash["holder"].alias("holder"))


@_query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'duplicate_value' WHEN 1 THEN 'field_errors' WHEN 2 THEN 'not_found' WHEN 3 THEN 'invalid_value' WHEN 4 THEN 'vendor_message' WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'server_error' ELSE 'forbidden' END AS error, event_id % 8 IN (5, 6) AS again FROM events")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    bodies = ['[{"message":"PropertyValueCoordinates{propertyName=email, value=x} on 1. 22 already has that value"}]', '{"message":"many","errors":[{"message":"bad"}]}', '{"message":" Resource not found "}', '[{"message":"7 was not a valid integer"}]', '{"message":"Something else"}', None, "not json", "{}"]
    turn = (F.col("event_id") % 8 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), turn)
    error = S.error_class(pick([400, 400, 400, 400, 409, 429, 503, 403]), pick(bodies))
    return stores.read(spark, d, "events", ["event_id"]).select("event_id", error.alias("error"), S.retries(error).alias("again"))


_FINDINGS = [(1, "TARGET_FIELD_MISSING", "b", "fax", "second"), (0, "TARGET_FIELD_MISSING", "b", "fax", "first"), (2, "INVENTED", "b", "fax", "no"), (3, "FIELD_TYPE_MISMATCH", None, "active", "third")]


@_query("SELECT * FROM (VALUES ('error', 'TARGET_FIELD_MISSING', 'b', 'fax', 'first'), ('error', 'FIELD_TYPE_MISMATCH', NULL, 'active', 'third')) v(severity, code, system, field, explanation)")
def findings_verified(spark: SparkSession, d: str) -> DataFrame:
    from tandem.plans.catalog import _issues

    findings = spark.createDataFrame(_FINDINGS, "position int, code string, system string, field string, explanation string")
    return Q.verified_findings(findings, _issues(spark, d))


@_query(X.SQL + _META + ", f AS (SELECT native FROM field WHERE system = 'b' AND required AND NOT read_only AND native NOT IN (SELECT native FROM rule WHERE system = 'b')) SELECT 'error' AS severity, 'FIELD_TYPE_MISMATCH' AS code, NULL::VARCHAR AS system, 'active' AS field UNION ALL SELECT 'error', 'REQUIRED_TARGET_UNMAPPED', 'b', native FROM f")
def issues_capped(spark: SparkSession, d: str) -> DataFrame:
    from tandem.plans.catalog import _issues

    return Q.capped_issues(_issues(spark, d).where("code IN ('FIELD_TYPE_MISMATCH', 'REQUIRED_TARGET_UNMAPPED', 'ENUM_VALUES_REQUIRE_REVIEW')"), 2)


@_query(X.SQL + "SELECT coalesce(ah.k, bh.k) AS k, ah.hash AS before, bh.hash AS now FROM ah FULL JOIN (FROM bh WHERE id NOT LIKE 'b2-%') bh ON ah.k = bh.k WHERE ah.hash IS DISTINCT FROM bh.hash")
def hash_differences(spark: SparkSession, d: str) -> DataFrame:
    of = lambda df: R.with_hash(df, X.FIELDS).select("k", "hash")
    return Q.map_differences(of(X.contact_a(spark, d)), of(X.contact_b(spark, d).where("id NOT LIKE 'b2-%'")), "k", "hash")


# Sources

@_query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS system, 'N' || p_partkey AS native, p_type AS type, p_size % 3 <> 0 AND p_size % 5 <> 0 AS required, p_size % 7 = 0 AS read_only, CASE WHEN p_size % 4 = 0 THEN (p_partkey % 2 = 0)::INTEGER + 1 ELSE 0 END::INTEGER AS n_options FROM part")
def schema_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Fields as a system describes them, one for each part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    option = lambda value, active: F.struct(value.alias("value"), active.alias("active"))
    return D.fields(stores.read(spark, d, "part").select(
        F.when(k % 2 == 0, "a").otherwise("b").alias("system"), F.concat(F.lit("N"), k.cast("string")).alias("native"), F.col("p_type").alias("type"), (size % 3 == 0).alias("nillable"), (size % 5 == 0).alias("defaulted"), (size % 7 != 0).alias("updateable"),
        F.when(size % 4 == 0, F.array(option(F.col("p_name"), k % 2 == 0), option(F.col("p_brand"), F.lit(True)), option(F.lit("old"), F.lit(False)))).alias("options"),
    ))


@_query("SELECT column_name AS native, 'events' AS system FROM (DESCRIBE events)")
def table_schema(spark: SparkSession, d: str) -> DataFrame:
    return D.table_fields(stores.read(spark, d, "events"), "events").select("native", "system")


@_query("SELECT n_name AS name, 'Label ' || n_nationkey AS label, n_regionkey = 1 AS registered, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS mapped_fields FROM nation UNION ALL SELECT 'standard', 'Standard', false, 0")
def object_catalog(spark: SparkSession, d: str) -> DataFrame:
    n = stores.read(spark, d, "nation")
    custom = n.select(F.col("n_name").alias("name"), F.concat(F.lit("Label "), F.col("n_nationkey").cast("string")).alias("label"))
    companions = custom.select(F.concat("name", F.lit("History")).alias("name"), "label").unionByName(custom.select(F.concat("name", F.lit("Share")).alias("name"), "label"))
    standard = spark.createDataFrame([("standard", "Standard")], "name string, label string")
    again = spark.createDataFrame([("standard", "Custom of the same name")], "name string, label string")
    rules = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("x"))).alias("native"))
    return Q.catalog(D.objects(standard, custom.unionByName(companions).unionByName(again)), n.where("n_regionkey = 1").select(F.col("n_name").alias("name")), rules)


@_query("SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'own-' || n_nationkey WHEN n_nationkey % 2 = 0 THEN n_name || 's' END AS counterpart FROM nation")
def catalog_registered(spark: SparkSession, d: str) -> DataFrame:
    n = stores.read(spark, d, "nation")
    a = n.select(F.col("n_name").alias("name"), F.concat(F.lit("no such label "), F.col("n_nationkey").cast("string")).alias("label"))
    b = n.where("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit("s")).alias("name"), F.lit("?").alias("label"))
    own = n.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("native_a"), F.concat(F.lit("own-"), F.col("n_nationkey").cast("string")).alias("native_b"))
    return Q.paired_objects(a, b, own)


@_query("""SELECT 'b:' || sha256(concat_ws(':', '7', CASE WHEN event_id % 2 = 0 THEN 'sub' || user_id % 5 ELSE '' END, CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR ELSE '' END,
    CASE event_type WHEN 'signup' THEN 'contact.creation' WHEN 'error' THEN 'contact.deletion' ELSE 'contact.propertyChange' END, user_id, epoch_us(ts) // 1000)) AS event_key, CASE WHEN user_id % 3 = 0 THEN 'contact' ELSE 'deal' END AS type,
  user_id::VARCHAR AS source_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS change, epoch_us(ts) // 1000 AS millis FROM events WHERE user_id % 3 <> 2""")
def posted_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as they are posted, a third of them without an id of their own."""
    e = stores.read(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    kind = F.when(F.col("event_type") == "signup", "contact.creation").when(F.col("event_type") == "error", "contact.deletion").otherwise("contact.propertyChange")
    row = F.struct(
        F.lit(7).alias("portalId"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sub"), (F.col("user_id") % 5).cast("string"))).alias("subscriptionId"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("eventId"), F.col("user_id").alias("objectId"),
        F.concat(F.lit("0-"), (F.col("user_id") % 3).cast("string")).alias("objectTypeId"), kind.alias("subscriptionType"), F.unix_millis(F.col("ts").cast("timestamp")).alias("occurredAt"),
    )
    types = spark.createDataFrame([("0-0", "contact"), ("0-1", "deal")], "object_id string, type string")
    found = D.posted_events(e.select(F.to_json(F.array(row)).alias("body")), types, "b")
    return found.select("event_key", "type", "source_id", "change", F.unix_millis("occurred_at").alias("millis"))


@_query("SELECT DISTINCT o_orderpriority AS system, o_orderstatus AS type, o_orderpriority || o_orderstatus AS hash FROM orders WHERE o_orderstatus <> 'F'")
def snapshots_new(spark: SparkSession, d: str) -> DataFrame:
    seen = stores.read(spark, d, "orders", ["o_orderpriority", "o_orderstatus"]).select(F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("type"), F.concat("o_orderpriority", "o_orderstatus").alias("hash"))
    return D.new_snapshots(seen.where("type = 'F'"), seen)


@_query(X.SQL + "SELECT id FROM a WHERE modified >= TIMESTAMP '2024-01-01 07:55:00'")
def lookback_scan(spark: SparkSession, d: str) -> DataFrame:
    return D.since_last_scan(X.contact_a(spark, d), "modified", "2024-01-01 08:00:00").select("id")


@_query(X.SQL + X.PLANS + ", m AS (SELECT * FROM p WHERE lower(coalesce(title, '')) = 'building') SELECT (SELECT count(*) FROM m) AS matching, min(source_id) AS first_id, arg_min(action, source_id) AS action FROM m")
def condition_dry_run(spark: SparkSession, d: str) -> DataFrame:
    a = X.contact_a(spark, d)
    hits = a.where(P.matches([P.Condition("title", "eq", "building")], a))
    first = hits.orderBy("id").limit(1)  # the sample record of the report
    plan = R.preview(first, X.contact_b(spark, d), X.links(spark, d), X.FIELDS)
    n = hits.agg(F.count("*").alias("matching"))
    return n.crossJoin(plan.agg(F.min("source_id").alias("first_id"), F.min("action").alias("action")))  # one row each


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'First Last' WHEN c_custkey % 3 = 1 THEN 'm' || c_custkey || '@x' ELSE c_custkey::VARCHAR END AS label FROM customer")
def record_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = stores.read(spark, d, "customer", ["c_custkey"]).select(k.cast("string").alias("id"), F.when(k % 3 == 0, "First").alias("firstName"), F.when(k % 3 == 0, "Last").otherwise("").alias("lastName"), F.when(k % 3 == 1, F.concat(F.lit("m"), k.cast("string"), F.lit("@x"))).alias("email"))
    return M.labelled(c, "contact").select(F.col("id").cast("long").alias("id"), "label")


@_query("SELECT v.value, CASE v.value WHEN 'BUILDING' THEN 'works' ELSE v.value END AS canonical FROM (SELECT c_mktsegment AS value FROM customer UNION SELECT o_orderpriority FROM orders) v")
def option_union(spark: SparkSession, d: str) -> DataFrame:
    value = lambda t, c: stores.read(spark, d, t, [c]).select(F.col(c).alias("value"))
    return Q.option_values(value("customer", "c_mktsegment"), value("orders", "o_orderpriority"), spark.createDataFrame([("BUILDING", "works")], "value string, canonical string"))


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'unknown_system' WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 5 <> 1 THEN 'raw_not_supported' WHEN c_custkey % 2 = 0 THEN 'unsafe_raw' END WHEN c_custkey % 3 = 0 THEN 'field' WHEN c_custkey % 11 = 0 THEN 'operator' END AS refused FROM customer")
def conditions_refused(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when((k % 7 == 0) & (k % 2 == 0), "x = 1; DROP TABLE y").when(k % 7 == 0, "updated > 1")
    system = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "a").otherwise("b")
    rows = stores.read(spark, d, "customer", ["c_custkey"]).select(k.alias("id"), system.alias("system"), F.when(k % 3 != 0, "email").otherwise(" ").alias("field"), F.when(k % 11 == 0, "like").otherwise("eq").alias("operator"), raw.alias("raw"))
    return P.refused_conditions(rows, ["a", "b"]).select("id", "refused")


@_query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'name' WHEN o_orderkey % 5 = 0 THEN 'source' WHEN o_orderkey % 3 = 0 THEN 'types' WHEN o_orderkey % 11 = 0 THEN 'per_type' END AS refused, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_types FROM orders")
def plans_refused(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    types = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("deal"), F.lit("contact"), F.lit("deal"))).otherwise(F.array(F.lit("deal")))
    name = F.when(k % 14 == 0, "  ").when(k % 7 == 0, F.repeat(F.lit("n"), 121)).otherwise(" plan ")
    asked = stores.read(spark, d, "orders", ["o_orderkey"]).select(k.alias("id"), name.alias("name"), F.when(k % 5 != 0, "a").alias("source"), types.alias("types"), F.when(k % 11 == 0, 0).when(k % 4 == 0, 100_000).alias("per_type"))
    return U.refused_plans(asked, ["a", "b"], ["contact", "deal"]).select("id", "refused", F.size("types").alias("n_types"))


@_query("WITH p AS (SELECT event_type, event_id % 5 AS changed, CASE WHEN event_id % 3 = 0 THEN 1 END AS deleted, event_id % 17 = 0 AS bad FROM events) SELECT event_type AS type, sum(changed)::BIGINT AS changed, coalesce(sum(deleted), 0)::BIGINT AS deleted, count(*) FILTER (WHERE bad) AS errors FROM p GROUP BY ROLLUP (event_type)")
def poll_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return U.poll_summary(stores.read(spark, d, "events", ["event_id", "event_type"]).select(F.col("event_type").alias("type"), (k % 5).alias("changed"), F.when(k % 3 == 0, 1).alias("deleted"), F.when(k % 17 == 0, "refused").alias("error")))


@_query("SELECT n_name AS name FROM nation WHERE contains(lower(coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, '') || ' nr ' || n_nationkey), 'a') AND n_regionkey <> 2")
def catalog_searched(spark: SparkSession, d: str) -> DataFrame:
    n = stores.read(spark, d, "nation", ["n_name", "n_nationkey", "n_regionkey"])
    rows = n.select("n_regionkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("shown"), F.concat(F.lit("Nr "), F.col("n_nationkey").cast("string")).alias("label"))
    return Q.searched(rows, " A ", ["shown", "label"], F.col("n_regionkey") != 2).select("name")


@_query("SELECT l_orderkey AS from_id, l_partkey AS to_id, 'holds' AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE '' END AS label, min(l_shipdate) AS first_at, max(l_shipdate) AS at FROM lineitem GROUP BY ALL")
def edges_stored(spark: SparkSession, d: str) -> DataFrame:
    rows = stores.read(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"])
    edges = rows.select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("holds").alias("kind"), F.when(F.col("l_linenumber") % 2 == 0, "even").alias("label"), F.col("l_shipdate").alias("at"), "l_linenumber")
    return R.edges_upserted(edges.where("l_linenumber <= 2").drop("l_linenumber"), edges.where("l_linenumber > 2").drop("l_linenumber"))


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END AS minutes, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS kept, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS inner_id FROM customer")
def setting_replaced(spark: SparkSession, d: str) -> DataFrame:
    c = stores.read(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    saved = F.when(F.col("c_custkey") % 9 != 0, F.to_json(F.struct(F.lit(30).alias("minutes"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_custkey").alias("id")).alias("nested"))))
    new = c.withColumn("settings", T.with_setting(saved, "minutes", F.col("c_nationkey").cast("string")))
    at = lambda path: F.get_json_object("settings", path)
    return new.select(F.col("c_custkey").alias("id"), at("$.minutes").cast("long").alias("minutes"), at("$.segment").alias("kept"), at("$.nested.id").cast("long").alias("inner_id"))


@_query("WITH " + X.EVENTS + " SELECT event_id FROM jobs WHERE status = 'dead_letter' ORDER BY ts DESC, event_id DESC LIMIT 25")
def jobs_listed(spark: SparkSession, d: str) -> DataFrame:
    from tandem.plans.catalog import _jobs

    return J.listed(_jobs(spark, d), 25, "dead_letter").select("event_id")


# Streams


def _signals(events: DataFrame) -> DataFrame:
    """What happens to the job of each event, in order: it is claimed and fails as often as its number says, and more often than it may."""
    changes = X.change_events(events)
    n = (F.col("event_id") % 10).cast("int")
    end = F.when(F.col("event_id") % 13 == 0, "ambiguous").when(F.col("change") == "deleted", "delete")
    tries = F.when(end.isNotNull(), F.array(F.lit("claim"), end)).otherwise(F.concat(F.flatten(F.array_repeat(F.array(F.lit("claim"), F.lit("fail")), n)), F.array(F.lit("claim"), F.lit("succeed"))))
    all_ = F.concat(F.array(F.lit("enqueue"), F.lit("enqueue")), tries, F.array(F.lit("fail")))
    return changes.select("event_key", F.unix_millis("occurred_at").alias("at"), F.posexplode(all_).alias("seq", "signal")).select("event_key", F.col("seq").cast("long").alias("seq"), "signal", (F.col("at") + 100_000 * F.col("seq")).alias("at"))


@_query("WITH " + X.EVENTS + " SELECT event_key, status, attempts FROM jobs")
def stream_job_states(spark: SparkSession, d: str) -> DataFrame:
    at = _checkpoint(spark)
    states = JS.job_states(E.event_stream(spark, d, "events", _signals))
    with JS.on_disk(spark):
        numbered = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/states")
        states.writeStream.outputMode("update").foreachBatch(numbered).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("status", "attempts"), "batch").alias("l")  # the newest row of a job is its state
    return spark.read.parquet(f"{at}/states").groupBy("event_key").agg(last).select("event_key", "l.*")


@_query("WITH " + X.EVENTS + X.SQL.replace("WITH", ",", 1) + " SELECT event_key, a.phone, a.id IS NULL AND change <> 'deleted' AS vanished FROM jobs LEFT JOIN a ON a.id = jobs.source_id")
def stream_current_records(spark: SparkSession, d: str) -> DataFrame:
    at, changes = _checkpoint(spark), E.event_stream(spark, d, "events", X.change_events)
    E.each_batch(changes, lambda batch: E.with_current(batch, X.contact_a(batch.sparkSession, d).select("id", "phone")).select("event_key", "phone", "vanished"), f"{at}/rows", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/rows")
