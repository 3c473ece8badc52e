"""More registered queries: records carried over in order, links kept, commands, timers, polls and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import carry as C
from tandem.operators import linkstore as K
from tandem.operators import naming as N
from tandem.operators import predicates as P
from tandem.plans import fixtures as X
from tandem.plans.catalog import _checkpoint, _plans, _query
from tandem.sources import discovery as D
from tandem.sources import polling as L
from tandem.sources import stores
from tandem.sources import versions as V
from tandem.streaming import alerts as A
from tandem.streaming import events as E
from tandem.streaming import jobs as JS

# Records that share a key, a link or a target

_HASH = "left(sha256('email=' || coalesce({0}, '') || '|phone=' || coalesce({1}, '') || '|title=' || coalesce({2}, '')), 16)"


def crowd(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of a, some of which are there twice or three times under one key."""
    a = X.contact_a(spark, d)
    second = a.where("k % 4 <= 1").withColumn("phone", F.when(F.col("k") % 3 == 0, F.concat(F.lit("P2-"), F.col("k").cast("string"))).otherwise(F.col("phone")))
    copy = lambda df, n: df.withColumn("id", F.concat("id", F.lit(n)))
    return a.unionByName(copy(second, "-2")).unionByName(copy(second.where("k % 8 = 0"), "-3"))


def crowd_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the first of them; some hold the key, so that the others find them by it."""
    key = X.contact_a(spark, d).select(F.col("id").alias("source_id"), "k", "key")
    found = X.links(spark, d).join(key, "source_id")
    keys = F.array_compact(F.array(F.when(F.col("k") % 4 == 0, F.col("key"))))
    return found.withColumn("source_hash", F.when(F.col("k") % 7 == 0, F.col("source_hash")).otherwise("old")).withColumn("keys", keys).withColumn("link_id", F.concat(F.lit("l-"), F.col("k").cast("string"))).drop("k", "key")


#: The same as a loop over the records of each k, one by one: the link made for the first (A), or by a later one (B), the target b-k, and what is left of them.
_LOOP = X.SQL.replace("WITH", "WITH RECURSIVE", 1) + f"""
, second AS (SELECT k, email, CASE WHEN k % 3 = 0 THEN 'P2-' || k ELSE phone END AS phone, title, modified, key FROM a WHERE k % 4 <= 1),
src AS (SELECT 'a-' || k AS id, k, email, phone, title, modified, key, 1 AS n FROM a UNION ALL SELECT 'a-' || k || '-2', *, 2 FROM second UNION ALL SELECT 'a-' || k || '-3', *, 3 FROM second WHERE k % 8 = 0),
sh AS (SELECT *, {_HASH.format("email", "phone", "title")} AS incoming, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM src),
own AS (SELECT a.k, l.target_hash, CASE WHEN a.k % 7 = 0 THEN l.source_hash ELSE 'old' END AS source_hash, a.k % 4 = 0 AND a.key IS NOT NULL AS keyed FROM l JOIN a ON a.id = l.source_id),
cand AS (SELECT key, count(*) AS n, min(id) AS one FROM b WHERE key IS NOT NULL GROUP BY key),
st AS (
  SELECT a.k, 0::BIGINT AS i, NULL::VARCHAR AS id, own.source_hash AS la_a, own.target_hash AS la_b, NULL::VARCHAR AS lb_a, NULL::VARCHAR AS lb_b, NULL::VARCHAR AS lb_to,
    bh.email AS te, bh.phone AS tp, bh.title AS tt, bh.modified AS tm, bh.hash AS th, NULL::VARCHAR AS status, NULL::VARCHAR AS op, NULL::VARCHAR AS target_id, false AS conflict, false AS write_back,
    NULL::VARCHAR AS source_hash, NULL::VARCHAR AS target_hash, NULL::VARCHAR AS lnk
  FROM a LEFT JOIN own USING (k) LEFT JOIN bh ON bh.id = 'b-' || a.k
  UNION ALL
  SELECT k, i, id, CASE WHEN done AND lnk = 'A' THEN back_hash ELSE la_a END, CASE WHEN done AND lnk = 'A' THEN wh ELSE la_b END,
    CASE WHEN done AND lnk = 'B' THEN back_hash ELSE lb_a END, CASE WHEN done AND lnk = 'B' THEN wh ELSE lb_b END, CASE WHEN done AND lnk = 'B' THEN at_ ELSE lb_to END,
    CASE WHEN done AND at_ = 'b-' || k THEN we ELSE te END, CASE WHEN done AND at_ = 'b-' || k THEN wp ELSE tp END, CASE WHEN done AND at_ = 'b-' || k THEN wt ELSE tt END,
    CASE WHEN done AND at_ = 'b-' || k THEN TIMESTAMP '2025-01-01' ELSE tm END, CASE WHEN done AND at_ = 'b-' || k THEN wh ELSE th END,
    status, CASE WHEN done THEN CASE WHEN goes_to IS NULL THEN 'create' ELSE 'update' END END, CASE WHEN done THEN at_ END, CASE WHEN done THEN clash END, CASE WHEN done THEN clash AND wh <> incoming END,
    CASE WHEN done THEN back_hash END, CASE WHEN done THEN wh END, lnk
  FROM (SELECT *, status = 'written' AS done, coalesce(goes_to, 'new-' || id) AS at_, CASE WHEN clash AND wh <> incoming THEN wh ELSE incoming END AS back_hash FROM (
    SELECT *, CASE WHEN coalesce(ha = incoming, false) THEN 'echo' WHEN vague THEN 'ambiguous' WHEN wt IS NULL THEN 'error' ELSE 'written' END AS status, {_HASH.format("we", "wp", "wt")} AS wh FROM (
      SELECT *, CASE WHEN clash AND NOT modified >= tm THEN te ELSE email END AS we, CASE WHEN clash AND NOT modified >= tm THEN tp ELSE phone END AS wp, CASE WHEN clash AND NOT modified >= tm THEN tt ELSE title END AS wt FROM (
        SELECT *, coalesce(goes_to = 'b-' || k, false) AND th IS DISTINCT FROM hb AS clash FROM (
          SELECT *, CASE lnk WHEN 'A' THEN la_a WHEN 'B' THEN lb_a END AS ha, CASE lnk WHEN 'A' THEN la_b WHEN 'B' THEN lb_b END AS hb, lnk = 'B' AND lb_to IS NULL AND coalesce(cn, 0) > 1 AS vague,
            CASE WHEN lnk = 'A' THEN 'b-' || k WHEN lnk = 'B' AND lb_to IS NOT NULL THEN lb_to WHEN lnk = 'B' AND cn = 1 THEN one END AS goes_to FROM (
            SELECT st.k, sh.i, sh.id, la_a, la_b, lb_a, lb_b, lb_to, te, tp, tt, tm, th, sh.email, sh.phone, sh.title, sh.modified, sh.incoming, cand.n AS cn, cand.one,
              CASE WHEN own.k IS NOT NULL AND (sh.n = 1 OR own.keyed) THEN 'A' WHEN sh.key IS NULL THEN 'N' ELSE 'B' END AS lnk
            FROM st JOIN sh ON sh.k = st.k AND sh.i = st.i + 1 LEFT JOIN own ON own.k = st.k LEFT JOIN cand ON cand.key = sh.key))))))) """


def _carried(spark: SparkSession, d: str) -> DataFrame:
    return C.reconciled(crowd(spark, d), X.contact_b(spark, d), crowd_links(spark, d), X.FIELDS, required=["title"], at=F.lit("2025-01-01 00:00:00").cast("timestamp"))


@_query(_LOOP + "SELECT id AS source_id, status, op, target_id, conflict, write_back, source_hash, target_hash FROM st WHERE i > 0")
def reconcile_loop_order(spark: SparkSession, d: str) -> DataFrame:
    return _carried(spark, d).select("source_id", "status", "op", "target_id", "conflict", "write_back", "source_hash", "target_hash")


@_query(_LOOP + """, done AS (SELECT * FROM st WHERE status = 'written'),
named AS (SELECT *, CASE lnk WHEN 'A' THEN 'l-' || k WHEN 'B' THEN 'link-' || min(id) OVER (PARTITION BY k, lnk) ELSE 'link-' || id END AS link_id FROM done),
last AS (SELECT link_id, arg_max(id, i) AS source_id, arg_max(target_id, i) AS target_id, arg_max(source_hash, i) AS source_hash, arg_max(target_hash, i) AS target_hash FROM named GROUP BY link_id),
old AS (SELECT 'l-' || k AS link_id, 'a-' || k AS source_id, 'b-' || k AS target_id, source_hash, target_hash, k FROM own)
SELECT link_id, coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.target_id, o.target_id) AS target_id, CASE WHEN n.link_id IS NOT NULL THEN n.source_hash ELSE o.source_hash END AS source_hash,
  CASE WHEN n.link_id IS NOT NULL THEN n.target_hash ELSE o.target_hash END AS target_hash FROM last n FULL JOIN old o USING (link_id)""")
def reconcile_key_links(spark: SparkSession, d: str) -> DataFrame:
    source, links = crowd(spark, d), crowd_links(spark, d)
    done = C.reconciled(source, X.contact_b(spark, d), links, X.FIELDS, required=["title"], at=F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return C.links_carried(links, done, source).drop("keys")


# Names


#: A name for each label of customers, one after the other, free of those before.
_NAMES = r"""
WITH RECURSIVE r AS (SELECT n_nationkey, n_name, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '_', 'g')) AS slug FROM nation),
lab AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS i, CASE WHEN c_custkey % 40 = 7 THEN ' -- ' WHEN c_custkey % 3 = 0 THEN n_name || ' ' || (c_custkey % 23) WHEN c_custkey % 31 = 1 THEN lower(n_name) || '_2 3' ELSE n_name END AS label
    FROM customer JOIN nation ON n_nationkey = c_nationkey),
b AS (SELECT id, i, label, coalesce(nullif(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'object') AS base FROM lab),
s AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS id, NULL::VARCHAR AS slug, (SELECT list(slug || '_4') FROM r WHERE n_nationkey % 2 = 0) AS taken
  UNION ALL
  SELECT i, id, slug, list_append(taken, slug) FROM (
    SELECT i, id, taken, CASE WHEN NOT list_contains(own, base) THEN base ELSE base || '_' || list_min(list_filter(range(2, len(own) + 3), lambda n: NOT list_contains(own, base || '_' || n))) END AS slug FROM (
      SELECT b.i, b.id, b.base, s.taken, list_filter(s.taken, lambda t: starts_with(t, b.base)) AS own FROM s JOIN b ON b.i = s.i + 1)))
SELECT id, slug FROM s WHERE i > 0
"""


@_query(_NAMES)
def numbered_slugs(spark: SparkSession, d: str) -> DataFrame:
    nation = stores.read(spark, d, "nation", ["n_nationkey", "n_name"])
    key, name = F.col("c_custkey"), F.col("n_name")
    label = (
        F.when(key % 40 == 7, " -- ").when(key % 3 == 0, F.concat_ws(" ", name, (key % 23).cast("string"))).when(key % 31 == 1, F.concat(F.lower(name), F.lit("_2 3"))).otherwise(name)
    )
    labels = stores.read(spark, d, "customer", ["c_custkey", "c_nationkey"]).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(key.alias("id"), label.alias("label"))
    taken = nation.where("n_nationkey % 2 = 0").select(F.concat(S.slug(F.col("n_name")), F.lit("_4")).alias("slug"))
    return N.named(labels, "label", "id", taken).select("id", "slug")


# Jobs that time moves

#: Jobs of users, moved by their events and by time, after WITH RECURSIVE; time ends ten minutes before the last event.
_TIMED = """
sig AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i,
    CASE event_type WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'approve' ELSE 'enqueue' END WHEN 'signup' THEN 'replay' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'succeed'
      ELSE CASE event_id % 3 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'dismiss' ELSE 'delete' END END AS signal FROM events),
m AS (
  SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::VARCHAR AS st, 0::BIGINT AS n, NULL::BIGINT AS due, NULL::BIGINT AS held, false AS del FROM sig
  UNION ALL
  SELECT user_id, i,
    CASE WHEN signal = 'enqueue' AND s2 IS NULL THEN 'queued' WHEN s2 IS NULL THEN NULL WHEN s2 = 'processing' AND signal = 'fail' THEN CASE WHEN n2 >= 8 THEN 'dead_letter' ELSE 'retry' END
      WHEN s2 = 'processing' AND signal IN ('delete', 'ambiguous') THEN 'manual_review' WHEN s2 = 'processing' AND signal = 'succeed' THEN 'completed' WHEN signal = 'replay' THEN 'queued'
      WHEN signal = 'approve' AND s2 = 'manual_review' AND del THEN 'completed' WHEN signal = 'dismiss' AND s2 IN ('dead_letter', 'manual_review', 'retry') THEN 'dismissed' ELSE s2 END,
    CASE WHEN signal = 'replay' AND s2 IS NOT NULL THEN 0 ELSE n2 END,
    CASE WHEN signal = 'enqueue' AND s2 IS NULL OR signal = 'replay' AND s2 IS NOT NULL THEN ms WHEN s2 = 'processing' AND signal = 'fail' AND n2 < 8 THEN ms + least(60000, 500 * 2 ** greatest(0, n2 - 1))::BIGINT
      WHEN s2 = 'retry' AND signal <> 'dismiss' OR s2 = 'queued' THEN due2 END,
    CASE WHEN s2 = 'processing' AND signal NOT IN ('fail', 'delete', 'ambiguous', 'succeed', 'replay') THEN h2 END, del OR coalesce(s2 = 'processing' AND signal = 'delete', false)
  FROM (SELECT *, s1 AS s2, n1 + CASE WHEN s1 = 'processing' THEN greatest(0, (ms - h1) // 43200000) ELSE 0 END AS n2, CASE WHEN s1 = 'processing' THEN h1 + greatest(0, (ms - h1) // 43200000) * 43200000 END AS h2, due1 AS due2 FROM (
    SELECT m.user_id, sig.i, sig.ms, sig.signal, m.del, CASE WHEN st IN ('queued', 'retry') AND due <= ms THEN 'processing' ELSE st END AS s1, n + CASE WHEN st IN ('queued', 'retry') AND due <= ms THEN 1 ELSE 0 END AS n1,
      CASE WHEN st IN ('queued', 'retry') AND due <= ms THEN due ELSE held END AS h1, CASE WHEN st IN ('queued', 'retry') AND due > ms THEN due END AS due1
    FROM m JOIN sig ON sig.user_id = m.user_id AND sig.i = m.i + 1))),
w AS (SELECT max(ms) - 600000 AS now FROM sig),
e1 AS (SELECT user_id, now, CASE WHEN st IN ('queued', 'retry') AND due <= now THEN 'processing' ELSE st END AS st, n + CASE WHEN st IN ('queued', 'retry') AND due <= now THEN 1 ELSE 0 END AS n, CASE WHEN st IN ('queued', 'retry') AND due <= now THEN due ELSE held END AS held
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM m) z, w WHERE r = 1 AND st IS NOT NULL),
e2 AS (SELECT user_id, st, n + CASE WHEN st = 'processing' THEN greatest(0, (now - held) // 43200000) ELSE 0 END AS n, CASE WHEN st = 'processing' THEN held + greatest(0, (now - held) // 43200000) * 43200000 END AS held FROM e1)
"""


def _user_signals(events: DataFrame) -> DataFrame:
    n, kind = F.col("event_id") % 3, F.col("event_type")
    click = F.when(n == 0, "ambiguous").when(n == 1, "dismiss").otherwise("delete")
    signal = F.when(kind == "view", F.when(n == 0, "approve").otherwise("enqueue")).when(kind == "signup", "replay").when(kind == "error", "fail").when(kind == "purchase", "succeed").otherwise(click)
    return events.select(F.col("user_id").cast("string").alias("event_key"), F.col("event_id").alias("seq"), signal.alias("signal"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


@_query("WITH RECURSIVE " + _TIMED + "SELECT user_id::VARCHAR AS event_key, st AS status, n AS attempts, held AS locked_at FROM e2")
def stream_job_timers(spark: SparkSession, d: str) -> DataFrame:
    """A job for each user: no signal claims it, so it comes to processing only by being due, or by a lease of twelve hours that runs out."""
    at = _checkpoint(spark)
    states = JS.timed_states(E.event_stream(spark, d, "events", _user_signals), lease=43_200_000)
    with JS.timers(spark):
        E.each_batch(states, lambda batch: batch, f"{at}/states", f"{at}/log").awaitTermination()
    newest = F.max_by(F.struct("status", F.col("attempts").cast("long").alias("attempts"), "locked_at"), F.struct("at", F.col("cause") == "timer")).alias("l")
    return spark.read.parquet(f"{at}/states").where("status IS NOT NULL").groupBy("event_key").agg(newest).select("event_key", "l.*")


# Polls by offset


_POLLED = """
SELECT 'a:poll:a:event:' || event_id || ':' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS event_key, event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS poll FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-22 12:00:00' AND event_type <> 'view'
"""


@_query(_POLLED)
def stream_polls(spark: SparkSession, d: str) -> DataFrame:
    """Two polls of one checkpoint: the first looks back five days, the second reads what has changed since the first began."""
    L.register(spark)
    at = _checkpoint(spark)
    for n, now in ((1, "2024-01-15T00:00:00+00:00"), (2, "2024-01-22T12:00:00+00:00")):
        rows = spark.readStream.format("polled").option("path", f"{d}/events.parquet").option("changed", "ts").option("lookbackDays", 5).option("now", now).load()
        seen = D.polled_changes(rows.where("event_type <> 'view'"), "a", "event", "event_id", "ts").withColumn("poll", F.lit(n))
        E.each_batch(seen, lambda batch: batch, f"{at}/seen", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/seen").select("event_key", F.col("source_id").cast("long").alias("event_id"), "poll")


@_query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type = 'error' AND user_id <= 40")
def polled_filters(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons that the source applies while it reads."""
    L.register(spark)
    rows = spark.read.format("polled").option("path", f"{d}/events.parquet").option("changed", "ts").load()
    return rows.where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp")) & (F.col("event_type") == "error") & (F.col("user_id") <= 40)).select("event_id", "user_id")


# Published tables


@_query(X.SQL + X.PLANS + """, n AS (SELECT count(*) AS n FROM p), cr AS (SELECT count(*) FILTER (action = 'create') AS n FROM p)
SELECT 1::BIGINT AS version, 'before' AS opened, n.n AS items, 1::BIGINT AS runs FROM n UNION ALL SELECT 2, 'after', n.n + cr.n, 2 FROM n, cr UNION ALL SELECT 3, 'replaced', n.n, 1 FROM n UNION ALL SELECT 4, 'upserted', n.n, 2 FROM n""")
def items_published(spark: SparkSession, d: str) -> DataFrame:
    """Items of runs, appended by run: who opened the first version goes on reading it, a replayed run adds nothing."""
    at = _checkpoint(spark)
    plans = _plans(spark, d).select("source_id", "action", F.lit("run-1").alias("run_id"))
    V.append(plans, at, "run-1")
    first = V.opened(spark, at)
    again = plans.where("action = 'create'").withColumn("run_id", F.lit("run-2"))
    for _ in range(2):
        V.append(again, at, "run-2")
    second = V.opened(spark, at)
    V.replace(second.where("run_id = 'run-1'"), at)
    third = V.opened(spark, at)
    V.upsert(again, at, ["source_id"])
    told = lambda df, number, name: df.agg(F.count("*").alias("items"), F.count_distinct("run_id").alias("runs")).select(F.lit(number).cast("long").alias("version"), F.lit(name).alias("opened"), "items", "runs")
    return told(first, 1, "before").unionByName(told(second, 2, "after")).unionByName(told(third, 3, "replaced")).unionByName(told(V.opened(spark, at), 4, "upserted"))


# Links in three tables


_WRITES = """
WITH w AS (SELECT o_orderkey AS seq, 'l-' || o_custkey % 500 AS link_id, CASE WHEN o_orderkey % 4 = 0 THEN 'company' ELSE 'contact' END AS type, CASE WHEN o_orderkey % 3 <> 0 THEN 'a-' || o_orderkey % 997 END AS a,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'b-' || o_custkey END AS b, CASE WHEN o_orderkey % 7 <> 0 THEN 'h' || o_orderkey % 10 END AS hash, 'k' || o_orderkey % 61 AS k1, CASE WHEN o_orderkey % 2 = 0 THEN 'k' || o_custkey % 53 END AS k2 FROM orders),
held AS (SELECT 'l-' || c_custkey % 500 AS link_id, min(c_custkey) AS c FROM customer GROUP BY 1),
s AS (SELECT seq, link_id, 'a' AS system, a AS native_id, hash FROM w WHERE a IS NOT NULL UNION ALL SELECT seq, link_id, 'b', b, hash FROM w WHERE b IS NOT NULL UNION ALL SELECT -1, link_id, 'a', 'a-old-' || c, 'old' FROM held),
n AS (SELECT seq, link_id, type, unnest([k1, k2]) AS k FROM w)
SELECT 'link' AS kind, link_id, type AS of, seq::VARCHAR AS value FROM (SELECT link_id, arg_max(type, seq) AS type, max(seq) AS seq FROM (SELECT link_id, type, seq FROM w UNION ALL SELECT link_id, 'contact', -1 FROM held) GROUP BY 1)
UNION ALL SELECT 'side', link_id, system, r.native_id || ':' || coalesce(r.hash, '') FROM (SELECT link_id, system, arg_max(struct_pack(native_id, hash), seq) AS r FROM s GROUP BY 1, 2)
UNION ALL SELECT 'key', arg_max(link_id, seq), type || '/' || k, '' FROM n WHERE k IS NOT NULL GROUP BY type, k
"""


@_query(_WRITES)
def links_written(spark: SparkSession, d: str) -> DataFrame:
    """The three tables after a link has been written for each order, over links that were there for customers."""
    o, c = stores.read(spark, d, "orders", ["o_orderkey", "o_custkey"]), stores.read(spark, d, "customer", ["c_custkey"])
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    k, cust, base = F.col("o_orderkey"), F.col("o_custkey"), F.lit(0).cast("timestamp")
    moment = lambda n: F.timestamp_seconds(n)
    side = lambda system, native: F.struct(F.lit(system).alias("system"), native.alias("native_id"), F.when(k % 7 != 0, text("h", k % 10)).alias("content_hash"), moment(k).alias("modified_at"))
    writes = o.select(
        k.alias("seq"), text("l-", cust % 500).alias("link_id"), F.when(k % 4 == 0, "company").otherwise("contact").alias("type"), moment(k).alias("at"),
        F.array(side("a", F.when(k % 3 != 0, text("a-", k % 997))), side("b", F.when(k % 5 != 0, text("b-", cust)))).alias("sides"), F.array(text("k", k % 61), F.when(k % 2 == 0, text("k", cust % 53))).alias("natural_keys"),
    )
    held = c.groupBy(text("l-", F.col("c_custkey") % 500).alias("link_id")).agg(F.min("c_custkey").alias("c"))
    links = held.select("link_id", F.lit("contact").alias("type"), moment(F.lit(-1)).alias("updated_at"))
    sides = held.select("link_id", F.lit("a").alias("system"), text("a-old-", F.col("c")).alias("native_id"), F.lit("old").alias("content_hash"), base.alias("modified_at"))
    links, sides, keys = K.written(links, sides, spark.createDataFrame([], K.KEYS), writes)
    of = lambda df, kind, what, value: df.select(F.lit(kind).alias("kind"), "link_id", what.alias("of"), value.alias("value"))
    return (
        of(links, "link", F.col("type"), F.unix_seconds("updated_at").cast("string")).unionByName(of(sides, "side", F.col("system"), F.concat("native_id", F.lit(":"), F.coalesce("content_hash", F.lit("")))))
        .unionByName(of(keys, "key", F.concat_ws("/", "type", "natural_key"), F.lit("")))
    )


# Streams that look things up

_ROUTED = "WITH " + X.EVENTS + X.SQL.replace("WITH", ",", 1) + """
SELECT event_key, CASE WHEN change = 'deleted' OR a.id IS NULL THEN linked.type WHEN lower(a.title) = 'building' THEN 'site' WHEN a.email IS NOT NULL THEN 'person' END AS type
FROM jobs LEFT JOIN a ON a.id = jobs.source_id LEFT JOIN (SELECT source_id, CASE WHEN target_id LIKE '%0' THEN 'site' ELSE 'person' END AS type FROM l) linked ON linked.source_id = jobs.source_id
WHERE CASE WHEN change = 'deleted' OR a.id IS NULL THEN linked.type WHEN lower(a.title) = 'building' THEN 'site' WHEN a.email IS NOT NULL THEN 'person' END = 'person' OR
  (CASE WHEN change = 'deleted' OR a.id IS NULL THEN linked.type WHEN lower(a.title) = 'building' THEN 'site' WHEN a.email IS NOT NULL THEN 'person' END = 'site' AND system = 'b')"""


@_query(_ROUTED)
def stream_routed(spark: SparkSession, d: str) -> DataFrame:
    """Changes as they come, each with the type of its record and only where the settings of that type let it through."""
    at, changes = _checkpoint(spark), E.event_stream(spark, d, "events", X.change_events)
    routes = [("site", [P.Condition("title", "eq", "building")]), ("person", [P.Condition("email", "is_not_null")])]

    def work(batch: DataFrame) -> DataFrame:
        s = batch.sparkSession
        linked = X.links(s, d).select(F.col("source_id").alias("id"), F.when(F.col("target_id").endswith("0"), "site").otherwise("person").alias("linked_type"))
        records = X.contact_a(s, d).select("id", "email", "title").join(linked, "id", "full")
        settings = s.createDataFrame([("site", "b_to_a", True), ("person", "both", True)], "type string, direction string, enabled boolean")
        return A.routed(batch, records, settings, routes).select("event_key", "type")

    E.each_batch(changes, work, f"{at}/rows", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@_query("SELECT DISTINCT 'u-' || user_id || ':' || CASE event_type WHEN 'error' THEN 'dead_letter' ELSE 'manual_review' END || ':' || event_id % 3 AS alert_key FROM events WHERE event_type IN ('error', 'click')")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """States of jobs as they come, told once each, although the whole stream is read again by a second run without a checkpoint."""
    at = _checkpoint(spark)
    status = F.when(F.col("event_type") == "error", "dead_letter").when(F.col("event_type") == "click", "manual_review").otherwise("completed")
    parse = lambda e: e.select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("event_key"), status.alias("status"), (F.col("event_id") % 3).alias("attempts"))
    for n in ("first", "again"):
        A.told_once(E.event_stream(spark, d, "events", parse), f"{at}/told", f"{at}/{n}").awaitTermination()
    return V.opened(spark, f"{at}/told").select("alert_key")
