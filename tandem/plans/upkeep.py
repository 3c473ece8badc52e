"""Queries over polls, deletions, reports and the upkeep of stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import jobs as J
from tandem.operators import mapping as M
from tandem.operators import polls as O
from tandem.operators import predicates as P
from tandem.operators import quality as Q
from tandem.operators import reconcile as R
from tandem.operators import runs as U
from tandem.plans import fixtures as X
from tandem.plans.catalog import _checkpoint, _plans, _query
from tandem.sources import discovery as D
from tandem.sources import stores
from tandem.sources import versions as V

# Polls


@_query(X.SQL + """, g AS (SELECT a.id, a.k, TIMESTAMP '2024-01-01' + to_minutes((a.k * 13 % 1000)::INTEGER) AS gone FROM a ANTI JOIN b ON a.k = b.k)
SELECT 'a:poll:a:contact:' || id || ':' || strftime(modified, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_key, 'updated' AS change FROM a WHERE modified >= TIMESTAMP '2024-01-01 08:00:00' AND lower(title) = 'building'
UNION ALL SELECT 'a:poll:a:contact:' || id || ':deleted:' || strftime(gone, '%Y-%m-%dT%H:%M:%S.%gZ'), 'deleted' FROM g WHERE gone >= TIMESTAMP '2024-01-01 08:00:00' AND k % 6 <> 0""")
def poll_found(spark: SparkSession, d: str) -> DataFrame:
    """A poll with conditions, deletion times, and deletions of another type of the same native object left out."""
    a, k = X.contact_a(spark, d), F.col("k")
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k * 13 % 1000 * 60_000_000)
    gone = stores.deleted_between(a, X.contact_b(spark, d), "k", at).join(a.select("k", "id"), "k")
    links = a.select(F.col("id").alias("source_id"), F.when(k % 6 == 0, "company").otherwise("contact").alias("type"))
    found = O.found(a, gone, F.lit("2024-01-01 08:00:00").cast("timestamp"), "a", "contact", [P.Condition("title", "eq", "building")], links)
    return found.select("event_key", "change")


_CRONS = ["0 9 * * 1", "not one", "", "61 * * * *", "*/5 * * * *"]


@_query(f"""WITH s AS (SELECT c_custkey AS k, 't' || c_nationkey AS type, CASE WHEN c_custkey % 9 <> 0 THEN true END AS enabled, c_custkey * 37 % 50000 AS minutes, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 400 END AS days, CASE WHEN c_custkey % 6 < 5 THEN {_CRONS}[c_custkey % 6 + 1] END AS cron FROM customer)
SELECT k, CASE WHEN type NOT IN (SELECT 't' || n_nationkey FROM nation WHERE n_regionkey <> 0) THEN 'unknown_type' WHEN enabled IS NULL THEN 'enabled' WHEN minutes NOT BETWEEN 1 AND 43200 THEN 'interval_minutes'
  WHEN days NOT BETWEEN 1 AND 365 THEN 'lookback_days' WHEN cron IN ('not one', '61 * * * *') THEN 'cron' END AS refused FROM s""")
def polling_refused(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cron = F.get(F.array(*map(F.lit, _CRONS)), (k % 6).cast("int"))
    settings = stores.read(spark, d, "customer", ["c_custkey", "c_nationkey"]).select(
        k.alias("k"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("type"), F.when(k % 9 != 0, True).alias("enabled"), (k * 37 % 50000).alias("interval_minutes"), F.when(k % 2 == 0, k % 400).alias("lookback_days"), cron.alias("cron"),
    )
    known = stores.read(spark, d, "nation", ["n_nationkey", "n_regionkey"]).where("n_regionkey <> 0").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("type"))
    return O.refused(settings, known).select("k", "refused")


# Deletions

_DELETES = X.SQL + """, j AS (SELECT 'e' || k AS event_key, id AS source_id, k, CASE WHEN k % 3 = 0 THEN 'updated' ELSE 'deleted' END AS change, CASE WHEN k % 4 < 2 THEN 'processing' ELSE 'manual_review' END AS status, CASE k % 5 WHEN 0 THEN 'cascade' WHEN 1 THEN 'ignore' WHEN 2 THEN 'manual-review' END AS policy FROM a),
o AS (SELECT *, change = 'deleted' AND (status = 'processing' AND coalesce(policy = 'cascade', false) OR status = 'manual_review' AND k % 7 < 3) AS taken FROM j) """


def _deletes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, a = F.col("k"), X.contact_a(spark, d)
    key = F.concat(F.lit("e"), k.cast("string")).alias("event_key")
    jobs = a.select(key, F.col("id").alias("source_id"), F.when(k % 3 == 0, "updated").otherwise("deleted").alias("change"), F.when(k % 4 < 2, "processing").otherwise("manual_review").alias("status"), F.when(k % 5 == 0, "cascade").when(k % 5 == 1, "ignore").when(k % 5 == 2, "manual-review").alias("policy"))
    return J.deletes_carried(jobs, a.where(k % 7 < 3).select(key), X.links(spark, d), X.contact_b(spark, d))


@_query(_DELETES + "SELECT event_key, CASE WHEN taken OR change = 'deleted' AND status = 'processing' AND coalesce(policy = 'ignore', false) THEN 'completed' WHEN change = 'deleted' AND status = 'processing' THEN 'manual_review' ELSE status END AS status FROM o")
def deletes_decided(spark: SparkSession, d: str) -> DataFrame:
    return _deletes(spark, d)[0].select("event_key", "status")


@_query(_DELETES + "SELECT id FROM b WHERE id NOT IN (SELECT target_id FROM l JOIN o ON o.source_id = l.source_id WHERE taken)")
def deletes_carried(spark: SparkSession, d: str) -> DataFrame:
    return _deletes(spark, d)[1].select("id")


# Reports and states


@_query("WITH " + X.EVENTS + """ SELECT event_key AS id, '{"id":"' || event_key || '","event":{"eventId":' || event_id || ',"system":"' || system || '","type":"contact","sourceId":"' || source_id || '","changeType":"' || change || '","occurredAt":"' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ')
  || '"},"status":"' || status || '","attempts":' || attempts || ',"nextAttemptAt":"2024-02-01T00:00:00.000Z"' || CASE WHEN status <> 'completed' THEN ',"lastError":"failed"' ELSE '' END || ',"createdAt":"' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') || '"}' AS report FROM jobs""")
def jobs_reported(spark: SparkSession, d: str) -> DataFrame:
    from tandem.plans.catalog import _jobs

    rows = _jobs(spark, d).withColumns({"id": F.col("event_key"), "type": F.lit("contact"), "next_attempt_at": F.lit("2024-02-01").cast("timestamp"), "last_error": F.when(F.col("status") != "completed", "failed"), "created_at": F.col("occurred_at")})
    return J.reported(rows)


@_query("WITH f AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size % 7 = 0 OR p_partkey % 2 = 0 AND p_brand LIKE '%1') AS m FROM part GROUP BY 1) SELECT count(*) FILTER (m = 0) AS not_started, count(*) FILTER (m > 0 AND m < n) AS review, count(*) FILTER (m = n) AS complete FROM f")
def mapping_states(spark: SparkSession, d: str) -> DataFrame:
    """Objects (brands) by how many of their fields (parts) are mapped."""
    parts = stores.read(spark, d, "part", ["p_partkey", "p_brand", "p_size"])
    fields = parts.select(F.col("p_brand").alias("system"), F.col("p_partkey").cast("string").alias("native"))
    mapped = parts.where((F.col("p_size") % 7 == 0) | ((F.col("p_partkey") % 2 == 0) & F.col("p_brand").endswith("1")))
    return Q.coverage_states(Q.coverage(mapped.select(F.col("p_brand").alias("system"), F.col("p_partkey").cast("string").alias("native")), fields))


@_query("WITH " + X.EVENTS + " SELECT event_key, CASE WHEN event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' THEN 'retry' WHEN event_id % 3 = 0 THEN 'processing' ELSE status END AS status, CASE WHEN event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' THEN coalesce(CASE WHEN event_id % 2 = 0 THEN 'said' END, 'worker lease expired') WHEN event_id % 2 = 0 THEN 'said' END AS last_error, event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' AS due FROM jobs")
def leases_recovered(spark: SparkSession, d: str) -> DataFrame:
    from tandem.plans.catalog import _jobs

    k, now = F.col("event_id"), F.lit("2024-01-20 00:05:00").cast("timestamp")
    jobs = _jobs(spark, d).withColumns({"status": F.when(k % 3 == 0, "processing").otherwise(F.col("status")), "locked_at": F.col("occurred_at"), "next_attempt_at": F.lit(None).cast("timestamp"), "last_error": F.when(k % 2 == 0, "said")})
    found = J.recovered(jobs, F.timestamp_add("MINUTE", F.lit(-5), now), now)
    return found.select("event_key", "status", "last_error", F.coalesce(F.col("next_attempt_at") == now, F.lit(False)).alias("due"))


# Stores


@_query("WITH held AS (SELECT o_custkey % 100 AS tenant, o_orderstatus AS metric, count(*) AS quantity FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2) SELECT tenant, metric, sum(quantity)::BIGINT AS quantity FROM (FROM held UNION ALL SELECT o_custkey % 100, o_orderstatus, 1 FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1, 2")
def usage_added(spark: SparkSession, d: str) -> DataFrame:
    o = stores.read(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]).select("o_orderkey", (F.col("o_custkey") % 100).alias("tenant"), F.col("o_orderstatus").alias("metric"), F.lit(1).cast("long").alias("quantity"))
    held = o.where("o_orderkey % 2 = 0").groupBy("tenant", "metric").agg(F.sum("quantity").alias("quantity"))
    return stores.added_up(held, o.where("o_orderkey % 2 = 1"), ["tenant", "metric"], "quantity")


@_query(X.SQL + "SELECT id FROM a WHERE k % 5 <> 0")
def store_deleted(spark: SparkSession, d: str) -> DataFrame:
    a = X.contact_a(spark, d)
    return stores.deleted(a, a.where("k % 5 = 0"), ["id"]).select("id")


@_query("SELECT c_custkey AS id, sha256('a:contact:' || c_custkey) AS canonical, left(sha256(c_name), 12) AS fingerprint FROM customer")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return stores.read(spark, d, "customer", ["c_custkey", "c_name"]).select(k.alias("id"), S.canonical_id(F.lit("a"), F.lit("contact"), k.cast("string")).alias("canonical"), S.fingerprint(F.col("c_name")).alias("fingerprint"))


@_query("SELECT 'l-' || c_custkey AS id, 'a-' || c_custkey AS a, CASE WHEN c_custkey % 3 <> 0 THEN 'b-' || c_custkey END AS b FROM customer")
def json_links(spark: SparkSession, d: str) -> DataFrame:
    """Links kept as JSON documents of a hundred, read back as rows."""
    at, k = f"{_checkpoint(spark)}/links", F.col("c_custkey")
    link = F.struct(F.concat(F.lit("l-"), k.cast("string")).alias("id"), F.struct(F.concat(F.lit("a-"), k.cast("string")).alias("a"), F.when(k % 3 != 0, F.concat(F.lit("b-"), k.cast("string"))).alias("b")).alias("ids"))
    stores.read(spark, d, "customer", ["c_custkey"]).groupBy(F.floor(k / 100)).agg(F.collect_list(link).alias("links")).select("links").write.json(at)
    found = spark.read.schema("links array<struct<id:string,ids:struct<a:string,b:string>>>").json(at)
    return found.select(F.inline("links")).select("id", "ids.a", "ids.b")


@_query("SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS amount, 'NAME' AS amount_of FROM lineitem")
def read_projection(spark: SparkSession, d: str) -> DataFrame:
    """Only the columns that rules name are read, each once whatever its case."""
    rules = [M.FieldRule("amount", "l_quantity"), M.FieldRule("again", "L_QUANTITY"), M.FieldRule("order", "l_orderkey"), M.FieldRule("line", "l_linenumber"), M.FieldRule("id", "Id")]
    rows = stores.read(spark, d, "lineitem", M.native_fields(rules))
    named = F.lit("NAME" if M.native_field(rules, "amount") == "l_quantity" and M.native_field(rules, "none") is None and rows.columns == ["l_quantity", "l_orderkey", "l_linenumber"] else "OTHER")
    return rows.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("amount"), named.alias("amount_of"))


@_query(X.SQL + """, lk AS (SELECT 'old-' || k AS source_id, 'b-' || k AS target_id, key, k FROM a WHERE k % 10 <> 8 AND k % 4 = 1 AND key IS NOT NULL)
SELECT a.id AS source_id, CASE WHEN concat_ws('', CASE WHEN a.email IS DISTINCT FROM t.email THEN 'e' END, CASE WHEN a.phone IS DISTINCT FROM t.phone THEN 'p' END, CASE WHEN a.title IS DISTINCT FROM t.title THEN 't' END) = '' THEN 'skip' ELSE 'update' END AS action, lk.target_id
FROM a JOIN lk ON lk.key = a.key JOIN b t ON t.id = lk.target_id""")
def preview_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Records whose link holds another source id, but their key."""
    a, k = X.contact_a(spark, d), F.col("k")
    text = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    links = a.where((k % 10 != 8) & (k % 4 == 1) & F.col("key").isNotNull()).select(text("old-").alias("source_id"), text("b-").alias("target_id"), F.lit(None).cast("string").alias("target_hash"), "key")
    found = R.preview(a.join(links.select("key"), "key", "left_semi"), X.contact_b(spark, d), links, X.FIELDS)
    return found.select("source_id", "action", "target_id")


@_query(X.SQL + X.PLANS + """, done AS (SELECT source_id, action FROM p WHERE action IN ('create', 'update'))
SELECT 'run.' || action AS action, source_id AS resource_id, '{"source_id":"' || source_id || '","action":"' || action || '"}' AS detail FROM done""")
def audit_appended(spark: SparkSession, d: str) -> DataFrame:
    """The audit of two runs, one of which is done again after a loss; a reader of the log sees each run once."""
    at, plans = _checkpoint(spark), _plans(spark, d).select("source_id", "action")
    for run in ("create", "update", "create"):
        rows = U.audited(plans.where(F.col("action") == run), "operator", f"run.{run}", F.lit("2024-01-01").cast("timestamp"), "contact", "source_id", ["source_id", "action"])
        V.append(rows, at, run)
    return V.opened(spark, at).select("action", "resource_id", "detail")


_POSTED = """
WITH e AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Contact' WHEN 1 THEN 'Account' WHEN 2 THEN 'Deal' ELSE 'Unknown' END AS object, 'r' || user_id AS record, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'view' THEN 'updated' END AS change,
    strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS at_, user_id, date_trunc('second', ts) AS moment FROM events),
t AS (SELECT *, CASE object WHEN 'Contact' THEN 'contact' WHEN 'Deal' THEN 'deal' WHEN 'Account' THEN CASE WHEN user_id % 3 = 0 THEN 'company' WHEN user_id % 3 = 1 THEN 'person' END END AS type FROM e)
SELECT 'a:' || sha256(object || ':' || record || ':' || coalesce(change, '') || ':' || at_) AS event_key, type, record AS source_id, coalesce(change, 'updated') AS change, epoch_ms(moment) AS millis FROM t WHERE type IS NOT NULL
"""


@_query(_POSTED)
def posted_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events posted a hundred a body; the accounts among them are companies or persons, by what their record is."""
    e, user = stores.read(spark, d, "events", ["event_id", "user_id", "ts", "event_type"]), F.col("user_id")
    kind, at = F.col("event_type"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    object_ = F.when(user % 4 == 0, "Contact").when(user % 4 == 1, "Account").when(user % 4 == 2, "Deal").otherwise("Unknown")
    change = F.when(kind == "signup", "created").when(kind == "error", "deleted").when(kind == "view", "updated")
    record = F.concat(F.lit("r"), user.cast("string"))
    event = F.struct(object_.alias("sobject"), record.alias("recordId"), change.alias("changeType"), at.alias("occurredAt"))
    posts = e.groupBy(F.floor(F.col("event_id") / 100)).agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("body"))
    types = spark.createDataFrame([("Contact", "contact"), ("Account", "company"), ("Account", "person"), ("Deal", "deal")], "object_id string, type string")
    now = e.where(user % 4 == 1).select(F.lit("Account").alias("object_id"), record.alias("source_id"), F.when(user % 3 == 0, "company").when(user % 3 == 1, "person").alias("type")).distinct()
    found = D.posted_changes(posts, types, "a", now)
    return found.select("event_key", "type", "source_id", "change", F.unix_millis("occurred_at").alias("millis"))


@_query("SELECT count(*) FILTER (p_size % 10 = 0) AS errors, count(*) FILTER (p_size % 10 = 1) AS warnings, count(*) FILTER (p_size % 10 = 0) = 0 AS ok, CASE WHEN count(*) FILTER (p_size % 10 = 0) > 0 THEN 'blocked' WHEN count(*) FILTER (p_size % 10 = 1) > 0 THEN 'review_required' ELSE 'ready' END AS readiness, count(*) AS fields_checked FROM part")
def fields_checked(spark: SparkSession, d: str) -> DataFrame:
    parts = stores.read(spark, d, "part", ["p_partkey", "p_size"])
    issues = parts.where("p_size % 10 < 2").select(F.when(F.col("p_size") % 10 == 0, "error").otherwise("warning").alias("severity"))
    return Q.checked(issues, parts)
