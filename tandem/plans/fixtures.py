"""Two systems derived from the driver's tables, as frames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.scalars import content_hash, event_key, natural_key
from tandem.sources.stores import read

FIELDS = ["email", "phone", "title"]


def _base(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("k"), F.when(k % 17 != 0, F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("+1 ("), F.col("c_nationkey").cast("string"), F.lit(") "), k.cast("string")).alias("phone"), F.col("c_mktsegment").alias("title"),
    )


def _record(df: DataFrame, prefix: str, minutes) -> DataFrame:
    modified = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + minutes * 60_000_000)
    return df.select(F.concat(F.lit(prefix), F.col("k").cast("string")).alias("id"), "k", *FIELDS, modified.alias("modified")).withColumn("key", natural_key({"email": F.col("email")}))


def contact_a(spark: SparkSession, d: str) -> DataFrame:
    return _record(_base(spark, d).where("k % 10 <> 9"), "a-", F.col("k") % 1000)


def contact_b(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    b = _base(spark, d).where("k % 10 <> 8").withColumns({
        "email": F.when(k % 3 == 0, F.upper("email")).otherwise(F.col("email")), "phone": F.when(k % 4 == 0, F.concat(F.lit("+1-999-"), k.cast("string"))).otherwise(F.col("phone")),
        "title": F.when(k % 6 != 0, F.col("title")),
    })
    return _record(b, "b-", 7 * k % 1000).unionByName(_record(b.where("k % 25 = 0"), "b2-", 7 * k % 1000))


def links(spark: SparkSession, d: str) -> DataFrame:
    b = contact_b(spark, d).where(F.col("id").startswith("b-") & (F.col("k") % 2 == 0) & (F.col("k") % 10 != 9))
    stored = F.when(F.col("k") % 5 == 0, "stale").otherwise(content_hash({f: F.col(f) for f in FIELDS}))
    a = contact_a(spark, d).select("k", content_hash({f: F.col(f) for f in FIELDS}).alias("source_hash"))
    return b.withColumn("target_hash", stored).join(a, "k").select(F.concat(F.lit("a-"), F.col("k").cast("string")).alias("source_id"), F.col("id").alias("target_id"), "target_hash", "source_hash")


def change_events(events: DataFrame) -> DataFrame:
    """Raw events as changes of records in two systems."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    system = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    return events.select("event_id", system.alias("system"), F.concat_ws("-", system, F.col("user_id").cast("string")).alias("source_id"), kind.alias("change"), F.col("ts").cast("timestamp").alias("occurred_at")).withColumn("event_key", event_key(F.col("system"), F.col("event_id"), F.col("source_id"), F.col("change")))


#: The same in DuckDB SQL; queries go on after it.
SQL = """
WITH base AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 17 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
    '+1 (' || c_nationkey || ') ' || c_custkey AS phone, c_mktsegment AS title FROM customer),
a AS (SELECT 'a-' || k AS id, k, email, phone, title, TIMESTAMP '2024-01-01' + to_minutes((k % 1000)::INTEGER) AS modified, lower(trim(email)) AS key FROM base WHERE k % 10 <> 9),
b0 AS (SELECT k, CASE WHEN k % 3 = 0 THEN upper(email) ELSE email END AS email, CASE WHEN k % 4 = 0 THEN '+1-999-' || k ELSE phone END AS phone,
    CASE WHEN k % 6 <> 0 THEN title END AS title, TIMESTAMP '2024-01-01' + to_minutes((7 * k % 1000)::INTEGER) AS modified FROM base WHERE k % 10 <> 8),
b AS (SELECT 'b-' || k AS id, k, email, phone, title, modified, lower(trim(email)) AS key FROM b0
    UNION ALL SELECT 'b2-' || k, k, email, phone, title, modified, lower(trim(email)) FROM b0 WHERE k % 25 = 0),
ah AS (SELECT *, left(sha256('email=' || coalesce(email, '') || '|phone=' || coalesce(phone, '') || '|title=' || coalesce(title, '')), 16) AS hash FROM a),
bh AS (SELECT *, left(sha256('email=' || coalesce(email, '') || '|phone=' || coalesce(phone, '') || '|title=' || coalesce(title, '')), 16) AS hash FROM b),
l AS (SELECT 'a-' || bh.k AS source_id, bh.id AS target_id, CASE WHEN bh.k % 5 = 0 THEN 'stale' ELSE bh.hash END AS target_hash, ah.hash AS source_hash
    FROM bh JOIN ah USING (k) WHERE bh.id LIKE 'b-%' AND bh.k % 2 = 0)
"""

#: Plans of all records of a, after SQL.
PLANS = """
, c AS (SELECT key, count(*) AS n, min(id) AS one FROM b WHERE key IS NOT NULL GROUP BY key),
j AS (SELECT a.id AS source_id, a.key, a.email, a.phone, a.title, l.target_id AS linked, l.target_hash, t.id AS read_id, c.n, CASE WHEN t.id IS NULL AND c.n = 1 THEN c.one END AS match_id
    FROM a LEFT JOIN l ON l.source_id = a.id LEFT JOIN b t ON t.id = l.target_id LEFT JOIN c ON c.key = a.key),
r AS (SELECT j.*, x.id AS target, x.hash AS hash, x.email AS e2, x.phone AS p2, x.title AS t2 FROM j LEFT JOIN bh x ON x.id = coalesce(j.read_id, j.match_id)),
d AS (SELECT *, concat_ws(',', CASE WHEN email IS DISTINCT FROM e2 THEN 'email' END, CASE WHEN phone IS DISTINCT FROM p2 THEN 'phone' END, CASE WHEN title IS DISTINCT FROM t2 THEN 'title' END) AS changed FROM r),
p AS (SELECT *, CASE WHEN read_id IS NULL AND n > 1 THEN 'ambiguous' WHEN target IS NULL THEN 'create' WHEN changed = '' THEN 'skip'
    WHEN coalesce(target_hash, '') <> '' AND target_hash <> hash THEN 'conflict' WHEN match_id IS NOT NULL AND linked IS NULL THEN 'match' ELSE 'update' END AS action FROM d)
"""

#: Change events, deduplicated, after WITH.
EVENTS = """ev AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS system, user_id, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS change FROM events),
jobs AS (SELECT *, system || '-' || user_id AS source_id, system || ':' || event_id AS event_key, event_id % 10 AS failures,
    CASE WHEN event_id % 13 = 0 OR change = 'deleted' THEN 'manual_review' WHEN event_id % 10 >= 8 THEN 'dead_letter' ELSE 'completed' END AS status,
    CASE WHEN event_id % 13 = 0 OR change = 'deleted' THEN 1 ELSE least(event_id % 10 + 1, 8) END::INTEGER AS attempts FROM ev)"""
