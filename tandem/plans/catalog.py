"""Registered queries and their SQL. Every query covers its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import jobs as J
from tandem.operators import mapping as M
from tandem.operators import predicates as P
from tandem.operators import quality as Q
from tandem.operators import reconcile as R
from tandem.plans import fixtures as X
from tandem.sources import stores
from tandem.streaming import events as E

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    """Queries by name; each takes (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict:
    """DuckDB SQL by query name."""
    return dict(_SQL)


def _plans(spark: SparkSession, d: str) -> DataFrame:
    return R.preview(X.contact_a(spark, d), X.contact_b(spark, d), X.links(spark, d), X.FIELDS)


# Plans


@_query(X.SQL + X.PLANS + "SELECT source_id, action, CASE WHEN action NOT IN ('ambiguous', 'create') THEN target END AS target_id, CASE action WHEN 'create' THEN 'email,phone,title' WHEN 'ambiguous' THEN '' ELSE changed END AS changed, "
        "CASE WHEN action = 'ambiguous' THEN n || ' target records share this natural key' WHEN action = 'create' AND key IS NULL THEN 'record has no configured natural key' WHEN match_id IS NOT NULL THEN 'existing target record will be linked' ELSE '' END AS warning FROM p")  # fmt: skip
def preview(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d).select("source_id", "action", "target_id", F.array_join(F.transform("field_diff", lambda x: x["field"]), ",").alias("changed"), F.array_join("warnings", "").alias("warning"))


@_query(X.SQL + X.PLANS + "SELECT action, count(*) AS n FROM p GROUP BY action")
def plan_actions(spark: SparkSession, d: str) -> DataFrame:
    return _plans(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@_query("SELECT type, id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS r FROM (SELECT 'contact' AS type, c_custkey AS id FROM customer UNION ALL SELECT 'company', s_suppkey FROM supplier UNION ALL SELECT 'deal', o_orderkey FROM orders)) WHERE r <= 25")
def plan_limited_per_type(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t, kind, key: stores.read(spark, d, t, [key]).select(F.lit(kind).alias("type"), F.col(key).alias("id"))
    return R.first_per_type(of("customer", "contact", "c_custkey").union(of("supplier", "company", "s_suppkey")).union(of("orders", "deal", "o_orderkey")), 25)


@_query(X.SQL + X.PLANS + "SELECT source_id, CAST(replace(source_id, 'a-', '') AS BIGINT) % 31 = 0 AS gone FROM p WHERE CAST(replace(source_id, 'a-', '') AS BIGINT) % 31 = 0 OR (action <> 'ambiguous' AND CAST(replace(source_id, 'a-', '') AS BIGINT) % 30 = 0)")
def plan_drift_check(spark: SparkSession, d: str) -> DataFrame:
    changed = X.contact_a(spark, d).where("k % 31 <> 0").withColumn("title", F.when(F.col("k") % 30 == 0, "CHANGED").otherwise(F.col("title")))
    return R.drifted(_plans(spark, d), R.preview(changed, X.contact_b(spark, d), X.links(spark, d), X.FIELDS))


@_query(X.SQL + X.PLANS + "SELECT source_id, 'email' AS field, email AS source_value, e2 AS target_value FROM p WHERE target IS NOT NULL AND email IS DISTINCT FROM e2 UNION ALL SELECT source_id, 'phone', phone, p2 FROM p WHERE target IS NOT NULL AND phone IS DISTINCT FROM p2 UNION ALL SELECT source_id, 'title', title, t2 FROM p WHERE target IS NOT NULL AND title IS DISTINCT FROM t2")
def field_diff_tall(spark: SparkSession, d: str) -> DataFrame:
    found = _plans(spark, d).where(~F.col("action").isin("create", "ambiguous")).select("source_id", F.inline("field_diff"))
    return found.toDF("source_id", "field", "source_value", "target_value")


# Conflicts

_PAIR = X.SQL + ", q AS (SELECT l.source_id, l.target_id, a.email AS ae, a.phone AS ap, a.title AS at_, a.modified AS am, b.email AS be, b.phone AS bp, b.title AS bt, b.modified AS bm FROM l LEFT JOIN a ON a.id = l.source_id LEFT JOIN b ON b.id = l.target_id) "


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.pairs(X.contact_a(spark, d), X.contact_b(spark, d), X.links(spark, d), X.FIELDS)


@_query(_PAIR + "SELECT source_id, target_id, 'b' AS winner, be AS email, bp AS phone, bt AS title FROM q")
def resolve_source_of_truth(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(_pairs(spark, d), X.FIELDS, "source-of-truth", source_of_truth="b")


@_query(_PAIR + "SELECT source_id, target_id, CASE WHEN am >= bm THEN 'a' ELSE 'b' END AS winner, CASE WHEN am >= bm THEN ae ELSE be END AS email, CASE WHEN am >= bm THEN ap ELSE bp END AS phone, CASE WHEN am >= bm THEN at_ ELSE bt END AS title FROM q")
def resolve_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(_pairs(spark, d), X.FIELDS, "last-write-wins")


@_query(_PAIR + "SELECT source_id, target_id, CASE WHEN am >= bm THEN coalesce(ae, be) ELSE coalesce(be, ae) END AS email, CASE WHEN am >= bm THEN coalesce(ap, bp) ELSE coalesce(bp, ap) END AS phone, CASE WHEN am >= bm THEN coalesce(at_, bt) ELSE coalesce(bt, at_) END AS title FROM q")
def resolve_field_merge(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(_pairs(spark, d), X.FIELDS, "field-merge")


@_query(_PAIR + "SELECT source_id, target_id, CASE WHEN am >= bm THEN coalesce(ae, be) ELSE coalesce(be, ae) END AS email, coalesce(bp, ap) AS phone, coalesce(at_, bt) AS title FROM q")
def resolve_owner_override(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve(_pairs(spark, d), X.FIELDS, "field-merge", owners={"phone": "b", "title": "a"})


# What plans write


@_query(X.SQL + "SELECT ah.id, ah.hash FROM ah LEFT JOIN l ON l.source_id = ah.id WHERE ah.k % 7 = 0 OR l.source_id IS NULL")
def echo_suppressed(spark: SparkSession, d: str) -> DataFrame:
    stale = F.when(F.expr("CAST(replace(source_id, 'a-', '') AS BIGINT) % 7 <> 0"), F.col("source_hash")).otherwise("old")
    return R.without_echoes(X.contact_a(spark, d), X.links(spark, d).withColumn("source_hash", stale), X.FIELDS).select("id", "hash")


@_query(X.SQL + X.PLANS + "SELECT source_id, CASE action WHEN 'create' THEN 'create' ELSE 'update' END AS op, CASE action WHEN 'create' THEN 'new-' || source_id ELSE target END AS target_id, CASE action WHEN 'create' THEN 3 ELSE len(string_split(changed, ',')) END::INTEGER AS n_fields, CASE WHEN action = 'create' OR contains(changed, 'phone') THEN phone END AS phone FROM p WHERE action IN ('create', 'update', 'match', 'conflict')")
def write_set(spark: SparkSession, d: str) -> DataFrame:
    return R.write_set(_plans(spark, d)).select("source_id", "op", "target_id", F.size("payload").alias("n_fields"), F.try_element_at("payload", F.lit("phone")).alias("phone"))


@_query(X.SQL + X.PLANS + "SELECT p.source_id, coalesce(CASE WHEN action <> 'create' THEN target END, 'new-' || p.source_id) AS target_id, ah.hash AS target_hash FROM p JOIN ah ON ah.id = p.source_id WHERE action <> 'ambiguous' UNION ALL SELECT l.source_id, l.target_id, l.target_hash FROM l JOIN p USING (source_id) WHERE p.action = 'ambiguous'")
def links_after_apply(spark: SparkSession, d: str) -> DataFrame:
    return R.links_after(_plans(spark, d), X.contact_a(spark, d), X.links(spark, d), X.FIELDS).select("source_id", "target_id", "target_hash")


@_query(X.SQL + "SELECT l.source_id, l.target_id FROM l JOIN a ON a.id = l.source_id WHERE a.k % 5 = 2")
def delete_propagation(spark: SparkSession, d: str) -> DataFrame:
    return R.propagated_deletes(X.contact_a(spark, d).where("k % 5 = 2"), X.links(spark, d))


def _refused(spark: SparkSession, d: str, mail: str = "email", other: str = "phone") -> DataFrame:
    """Writes refused because another record holds a unique value: of the key field, of another one, held by the target itself, or another error."""
    k = F.col("k")
    field = F.when(k % 4 == 1, other).when(k % 8 == 4, F.lit(mail if mail == "email" else mail.title())).otherwise(mail)
    holder = F.when(k % 4 == 2, F.concat(F.lit("b-"), k.cast("string"))).otherwise(F.concat(F.lit("x-"), k.cast("string")))
    said = F.when(k % 4 == 3, "Some other error").otherwise(F.concat(F.lit("Cannot set PropertyValueCoordinates{portalId=1, propertyName="), field, F.lit(", value=v"), k.cast("string"), F.lit("} on "), k.cast("string"), F.lit(". "), holder, F.lit(" already has that value.")))
    return X.contact_a(spark, d).select(F.col("id").alias("source_id"), F.concat(F.lit("b-"), k.cast("string")).alias("target_id"), F.to_json(F.struct(said.alias("message"))).alias("body"))


@_query(X.SQL + "SELECT id AS source_id, CASE WHEN k % 4 = 0 THEN 'x-' || k ELSE 'b-' || k END AS target_id, CASE WHEN k % 4 = 0 THEN 'relinked' ELSE 'error' END AS status FROM a")
def self_heal_refused(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("email", "MAIL"), ("phone", "phone_no")], "canonical string, native string")
    return R.retargeted(_refused(spark, d, "mail", "phone_no"), ["email"], rules)


@_query(X.SQL + "SELECT id, concat_ws(',', CASE WHEN coalesce(email, '') = '' THEN 'email' END, CASE WHEN coalesce(title, '') = '' THEN 'title' END) AS missing FROM b WHERE coalesce(email, '') = '' OR coalesce(title, '') = ''")
def required_missing(spark: SparkSession, d: str) -> DataFrame:
    return P.missing_required(X.contact_b(spark, d), ["email", "title"]).select("id", F.array_join("missing", ",").alias("missing"))


@_query(X.SQL + "SELECT id, CASE WHEN key IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY key ORDER BY id) END AS linked_by FROM b")
def loop_order_links(spark: SparkSession, d: str) -> DataFrame:
    return R.first_of_key(X.contact_b(spark, d)).select("id", "linked_by")


# Mapping

_RULES = [M.FieldRule("email", "Email", "lowercase"), M.FieldRule("phone", "Phone", "phone"), M.FieldRule("title", "Title", "trim"), M.FieldRule("company", "Account.Name", read_only=True), M.FieldRule("owner", "OwnerId")]
_SEGMENTS = M.ValueMap("title", (("home", "HOUSEHOLD"), ("home", "FURNITURE"), ("plant", "MACHINERY"), ("works", "BUILDING")))
_STAGES = M.ValueMap("stage", (("won", "F"), ("open", "O"), ("pending", "P")))


def _native(spark: SparkSession, d: str) -> DataFrame:
    b = X.contact_b(spark, d)
    return b.select("id", F.concat(F.lit(" "), "email", F.lit("\t")).alias("Email"), F.col("phone").alias("Phone"), F.col("title").alias("Title"), F.struct(F.concat(F.lit("Company "), F.col("k").cast("string")).alias("Name")).alias("Account"), "k")


_CANON = X.SQL + ", n AS (SELECT id, lower(email) AS email, regexp_replace(phone, '[^0-9+]', '', 'g') AS phone, CASE title WHEN 'HOUSEHOLD' THEN 'home' WHEN 'FURNITURE' THEN 'home' WHEN 'MACHINERY' THEN 'plant' WHEN 'BUILDING' THEN 'works' ELSE title END AS title, 'Company ' || k AS company FROM b) "


@_query(_CANON + "SELECT id, email, phone, title, company, NULL::VARCHAR AS owner FROM n")
def to_canonical_contact(spark: SparkSession, d: str) -> DataFrame:
    return M.to_canonical(_native(spark, d), _RULES, (_SEGMENTS,))


@_query(_CANON + "SELECT id, email AS \"Email\", phone AS \"Phone\", CASE title WHEN 'home' THEN 'HOUSEHOLD' WHEN 'plant' THEN 'MACHINERY' WHEN 'works' THEN 'BUILDING' ELSE title END AS \"Title\", NULL::VARCHAR AS \"OwnerId\" FROM n")
def from_canonical_contact(spark: SparkSession, d: str) -> DataFrame:
    return M.from_canonical(M.to_canonical(_native(spark, d), _RULES, (_SEGMENTS,)), _RULES, (_SEGMENTS,))


@_query("SELECT o_orderkey AS id, 'Order ' || o_orderkey AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS stage, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS close_date FROM orders")
def to_canonical_deal(spark: SparkSession, d: str) -> DataFrame:
    o = stores.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("Name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("Amount"), F.col("o_orderstatus").alias("Stage"), F.col("o_orderdate").cast("string").alias("CloseDate"))
    return M.to_canonical(o, [M.FieldRule("name", "Name"), M.FieldRule("amount", "Amount"), M.FieldRule("stage", "Stage"), M.FieldRule("close_date", "CloseDate", "iso-date")], (_STAGES,))


@_query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages")
def transform_domain(spark: SparkSession, d: str) -> DataFrame:
    return stores.read(spark, d, "pages", ["page_id", "url"]).select("page_id", S.domain(F.col("url")).alias("host"))


@_query(X.SQL + "SELECT id, regexp_replace(phone, '[^0-9+]', '', 'g') AS phone FROM b")
def transform_phone(spark: SparkSession, d: str) -> DataFrame:
    return X.contact_b(spark, d).select("id", S.phone(F.col("phone")).alias("phone"))


@_query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN 26 WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE NULL END::DOUBLE AS n FROM events")
def transform_number(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".0"))).when(k == 1, "0x1A").when(k == 2, "Infinity").when(k == 3, " ").otherwise("")
    return stores.read(spark, d, "events", ["event_id"]).select("event_id", S.number(raw).alias("n"))


@_query("SELECT event_id, event_id % 4 IN (0, 1) AS flag, event_id % 4 IN (0, 1) AS yes, event_id % 4 = 0 AS word FROM events")
def transform_bool(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("TRUE"), F.lit("1"), F.lit(" Yes "), F.lit("no")), (F.col("event_id") % 4 + 1).cast("int"))
    return stores.read(spark, d, "events", ["event_id"]).select("event_id", S.boolean(raw).alias("flag"), S.yes_no(raw).alias("yes"), S.true_false(raw).alias("word"))


@_query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts) // 1000 AS millis FROM events")
def transform_dates(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("string")
    return stores.read(spark, d, "events", ["event_id", "ts"]).select("event_id", S.iso_date(ts).alias("iso"), S.epoch_millis(ts).alias("millis"))


@_query("SELECT c_custkey AS id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home' WHEN 'FURNITURE' THEN 'home' WHEN 'MACHINERY' THEN 'plant' WHEN 'BUILDING' THEN 'works' ELSE c_mktsegment END AS canonical, CASE c_mktsegment WHEN 'FURNITURE' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS native FROM customer")
def value_map_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = stores.read(spark, d, "customer", ["c_custkey", "c_mktsegment"]).select(F.col("c_custkey").alias("id"), _SEGMENTS.to_canonical(F.col("c_mktsegment")).alias("canonical"))
    return c.withColumn("native", _SEGMENTS.to_native(F.col("canonical")))


# Conditions


def _matching(df: DataFrame, *conditions: P.Condition) -> DataFrame:
    return df.where(P.matches(list(conditions), df))


@_query(X.SQL + "SELECT id FROM b WHERE lower(coalesce(title, '')) = 'building'")
def cond_eq(spark: SparkSession, d: str) -> DataFrame:
    return _matching(X.contact_b(spark, d), P.Condition("title", "eq", "Building")).select("id")


@_query(X.SQL + "SELECT id FROM b WHERE title IS NULL OR lower(title) <> 'building'")
def cond_ne_null(spark: SparkSession, d: str) -> DataFrame:
    return _matching(X.contact_b(spark, d), P.Condition("title", "ne", "building")).select("id")


@_query("SELECT event_id FROM events WHERE value > 100.5 AND value < 200")
def cond_gt(spark: SparkSession, d: str) -> DataFrame:
    return _matching(stores.read(spark, d, "events", ["event_id", "value"]), P.Condition("value", "gt", 100.5), P.Condition("value", "lt", 200)).select("event_id")


@_query(X.SQL + "SELECT id FROM b WHERE contains(lower(email), '1@example')")
def cond_contains(spark: SparkSession, d: str) -> DataFrame:
    return _matching(X.contact_b(spark, d), P.Condition("email", "contains", "1@EXAMPLE")).select("id")


@_query(X.SQL + "SELECT id FROM b WHERE email IS NULL AND title IS NOT NULL")
def cond_null(spark: SparkSession, d: str) -> DataFrame:
    return _matching(X.contact_b(spark, d), P.Condition("email", "is_null"), P.Condition("title", "is_not_null"), P.Condition("nowhere", "is_null")).select("id")


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('O', 'P')")
def cond_raw(spark: SparkSession, d: str) -> DataFrame:
    return stores.read(spark, d, "orders").where(P.raw("o_totalprice > 1000 AND o_orderstatus IN ('O', 'P')")).select("o_orderkey")


@_query("WITH " + X.EVENTS + " SELECT change, count(*) AS n FROM jobs WHERE (change = 'created' AND system = 'a') OR change = 'updated' GROUP BY change")
def direction_policy(spark: SparkSession, d: str) -> DataFrame:
    policy = spark.createDataFrame([("created", "a_to_b", True), ("updated", "both", True), ("deleted", "both", False)], "change string, direction string, enabled boolean")
    found = X.change_events(stores.read(spark, d, "events")).join(F.broadcast(policy), "change", "left")  # three rows
    return found.where(P.direction_allows(F.col("direction"), F.col("enabled"), F.col("system"))).groupBy("change").agg(F.count("*").alias("n"))


@_query(X.SQL + "SELECT type, count(*) AS n FROM (SELECT CASE WHEN lower(title) = 'building' THEN 'site' WHEN email IS NOT NULL AND title IS NOT NULL THEN 'person' END AS type FROM b) WHERE type IS NOT NULL GROUP BY type")
def type_routing(spark: SparkSession, d: str) -> DataFrame:
    routes = [("site", [P.Condition("title", "eq", "building")]), ("person", [P.Condition("email", "is_not_null"), P.Condition("title", "is_not_null")])]
    return P.route(X.contact_b(spark, d), routes).groupBy("type").agg(F.count("*").alias("n"))


# Scans and keys


@_query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    return stores.since(stores.read(spark, d, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "value")


@_query(X.SQL + "SELECT a.k FROM a ANTI JOIN b ON a.k = b.k")
def deletions_since(spark: SparkSession, d: str) -> DataFrame:
    return stores.deleted_between(X.contact_a(spark, d), X.contact_b(spark, d), "k")


@_query("SELECT count(*) FILTER (key IS NULL) AS missing, count(DISTINCT key) AS n_keys, (SELECT count(*) FROM (SELECT text FROM documents WHERE trim(text) <> '' GROUP BY text HAVING count(*) > 1)) AS duplicate_keys FROM (SELECT nullif(text, '') AS key FROM documents)")
def natural_key_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.key_profile(stores.read(spark, d, "documents", ["text"]), F.nullif(F.col("text"), F.lit("")))


@_query("SELECT 0::BIGINT AS missing, count(*) AS n_keys, count(*) FILTER (n > 1) AS duplicate_keys FROM (SELECT lower(trim(p_name)), lower(trim(p_brand)), count(*) AS n FROM part GROUP BY 1, 2)")
def composite_key_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.key_profile(stores.read(spark, d, "part", ["p_name", "p_brand"]), S.natural_key({"name": F.col("p_name"), "brand": F.col("p_brand")}))


@_query(X.SQL + "SELECT 'email:' || key AS key, count(*) AS n FROM b WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1")
def ambiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates(X.contact_b(spark, d)).where("n_candidates > 1").select("key", F.col("n_candidates").alias("n"))


@_query(X.SQL + "SELECT id, hash FROM bh")
def content_hash_contact(spark: SparkSession, d: str) -> DataFrame:
    return R.with_hash(X.contact_b(spark, d), X.FIELDS).select("id", "hash")


@_query("SELECT left(sha256('text=' || coalesce(text, '')), 16) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = stores.read(spark, d, "documents", ["doc_id", "text"]).select("doc_id", S.content_hash({"text": F.col("text")}).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@_query(X.SQL + "SELECT source_id AS link_id, source_id AS a_id, NULL::VARCHAR AS a_hash, target_id AS b_id, target_hash AS b_hash FROM l")
def links_pivot(spark: SparkSession, d: str) -> DataFrame:
    side = lambda system, native, h: X.links(spark, d).select(F.col("source_id").alias("link_id"), F.lit(system).alias("system"), F.col(native).alias("native_id"), h.alias("hash"))
    return R.links_wide(side("a", "source_id", F.lit(None).cast("string")).union(side("b", "target_id", F.col("target_hash"))))


def _associated(spark: SparkSession, d: str) -> DataFrame:
    o = stores.read(spark, d, "orders", ["o_orderkey", "o_custkey"])
    edges = o.select(F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("a-"), F.col("o_custkey").cast("string")).alias("to_id"), F.lit("deal_contact").alias("kind"))
    deals = o.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("e-"), F.col("o_orderkey").cast("string")).alias("target_id"))
    return R.associations(edges, deals, X.links(spark, d))


_EDGES = X.SQL + ", g AS (SELECT 'd-' || o_orderkey AS from_id, 'a-' || o_custkey AS to_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'e-' || o_orderkey END AS from_target, l.target_id AS to_target FROM orders LEFT JOIN l ON l.source_id = 'a-' || o_custkey), gh AS (SELECT *, sha256(from_target || ':' || to_target || ':deal_contact') AS h FROM g) "


@_query(_EDGES + "SELECT from_target, to_target, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] AS association_id FROM gh WHERE from_target IS NOT NULL AND to_target IS NOT NULL")
def associations_resolved(spark: SparkSession, d: str) -> DataFrame:
    found = _associated(spark, d).where("status = 'synced'")
    return found.select("from_target", "to_target", S.association_id(F.col("from_target"), F.col("to_target"), F.col("kind")).alias("association_id"))


@_query(_EDGES + "SELECT from_id, to_id FROM gh WHERE from_target IS NULL OR to_target IS NULL")
def associations_deferred(spark: SparkSession, d: str) -> DataFrame:
    return _associated(spark, d).where("status = 'deferred'").select("from_id", "to_id")


# Checks before a run

_RULE_ROWS = [("a", "email", "Email", "lowercase", "lowercase", False), ("a", "phone", "Phone", None, None, False), ("a", "company", "Account.Name", None, None, False), ("a", "owner", "Owner.Name", None, None, False), ("a", "fax", "Fax", None, None, False),
              ("a", "active", "Active", None, None, False), ("a", "stage", "Stage", None, None, False), ("a", "vip", "Vip", "yes-no", "yes-no", False), ("a", "score", "Score", "number", None, False),
              ("b", "email", "email", None, None, False), ("b", "phone", "phone", None, None, False), ("b", "company", "company", None, None, False), ("b", "fax", "fax", None, None, False), ("b", "active", "active", None, None, False), ("b", "stage", "stage", None, None, False),
              ("b", "vip", "vip", None, None, False), ("b", "score", "score", "identity", None, False), ("b", "created", "created_at", None, None, True), ("b", "gone", "gone", None, None, True), ("b", "path", "deep.path", None, None, False)]
_SCHEMA_ROWS = [("a", "Email", "string", True, False, 0), ("a", "Phone", "string", False, False, 0), ("a", "Account", "reference", False, False, 0), ("a", "Active", "boolean", False, False, 0), ("a", "Stage", "picklist", False, False, 3), ("a", "Vip", "boolean", False, False, 0), ("a", "Score", "Number", False, False, 0),
                ("b", "email", "string", True, False, 0), ("b", "phone", "string", False, True, 0), ("b", "company", "string", False, False, 0), ("b", "active", "enumeration", False, False, 2), ("b", "stage", "enumeration", False, False, 4), ("b", "vip", "enumeration", False, False, 2), ("b", "score", "number", False, False, 0),
                ("b", "created_at", "datetime", True, True, 0), ("b", "domain", "string", True, False, 0), ("b", "hidden", "string", True, True, 0)]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    """Literal rows as a common table expression."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns}))"


def _rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(_RULE_ROWS, "system string, canonical string, native string, read string, write string, read_only boolean"), spark.createDataFrame(_SCHEMA_ROWS, "system string, native string, type string, required boolean, read_only boolean, n_options int")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    rules, schemas = _rules(spark)
    return Q.preflight(rules, schemas, R.key_profile(X.contact_a(spark, d), F.col("key")), R.key_profile(X.contact_b(spark, d), F.col("key")))


_TYPE = "CASE WHEN {0} IN ('int', 'integer', 'long', 'double', 'number', 'currency') THEN 'number' WHEN {0} IN ('date', 'datetime', 'dateTime') THEN 'date' WHEN {0} IN ('bool', 'boolean') THEN 'boolean' WHEN {0} IN ('enumeration', 'picklist', 'multipicklist') THEN 'enum' ELSE 'string' END"
_META = ", " + _values("rule", "system, canonical, native, read, write, read_only", _RULE_ROWS) + ", " + _values("field", "system, native, type, required, read_only, n_options", _SCHEMA_ROWS)
_ISSUES = X.SQL + _META + f"""
, src AS (SELECT r.*, coalesce(f.type, g.type) AS type_a, CASE WHEN f.native IS NOT NULL THEN f.n_options ELSE g.n_options END AS options_a FROM rule r
    LEFT JOIN field f ON f.system = 'a' AND f.native = r.native LEFT JOIN field g ON g.system = 'a' AND g.native = string_split(r.native, '.')[1] WHERE r.system = 'a'),
tgt AS (SELECT r.*, f.type AS type_b, f.read_only AS fixed, f.n_options AS options_b FROM rule r LEFT JOIN field f ON f.system = 'b' AND f.native = r.native WHERE r.system = 'b'),
two AS (SELECT t.*, s.type_a, s.options_a, coalesce(s.read, 'identity') <> 'identity' AND coalesce(s.write, 'identity') <> 'identity' AS solved_a, coalesce(t.read, 'identity') <> 'identity' AND coalesce(t.write, 'identity') <> 'identity' AS solved_b
    FROM tgt t JOIN src s USING (canonical) WHERE t.type_b IS NOT NULL AND s.type_a IS NOT NULL),
meta AS (SELECT CASE WHEN contains(native, '.') THEN 'warning' ELSE 'error' END AS severity, CASE WHEN contains(native, '.') THEN 'RELATIONSHIP_FIELD_UNVERIFIED' ELSE 'SOURCE_FIELD_MISSING' END AS code, 'a' AS system, native AS field FROM src WHERE type_a IS NULL
  UNION ALL SELECT 'error', 'TARGET_FIELD_MISSING', 'b', native FROM tgt WHERE type_b IS NULL AND NOT read_only AND NOT contains(native, '.')
  UNION ALL SELECT 'error', 'TARGET_FIELD_READ_ONLY', 'b', native FROM tgt WHERE fixed AND NOT read_only
  UNION ALL SELECT CASE WHEN read IS NOT NULL OR write IS NOT NULL THEN 'warning' ELSE 'error' END, 'FIELD_TYPE_MISMATCH', NULL, canonical FROM two WHERE {_TYPE.format('type_a')} <> {_TYPE.format('type_b')} AND NOT solved_a AND NOT solved_b
  UNION ALL SELECT 'warning', 'ENUM_VALUES_REQUIRE_REVIEW', NULL, canonical FROM two WHERE options_a > 0 AND options_b > 0
  UNION ALL SELECT 'error', 'REQUIRED_TARGET_UNMAPPED', 'b', native FROM field f WHERE system = 'b' AND required AND NOT read_only AND NOT EXISTS (FROM rule r WHERE r.system = 'b' AND r.native = f.native)),
issues AS (SELECT * FROM meta
  UNION ALL SELECT 'warning', 'NATURAL_KEY_MISSING_VALUES', 'a', 'natural key' FROM a WHERE key IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'warning', 'SOURCE_NATURAL_KEY_DUPLICATES', 'a', 'natural key' FROM (SELECT key FROM a WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'error', 'TARGET_NATURAL_KEY_DUPLICATES', 'b', 'natural key' FROM (SELECT key FROM b WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1) HAVING count(*) > 0) """


@_query(_ISSUES + "SELECT * FROM issues")
def preflight_issues(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)


@_query(_ISSUES + "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, false AS ok, 'blocked' AS readiness FROM issues")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return Q.readiness(_issues(spark, d))


@_query("SELECT n_name AS name, 'nation' || r_regionkey AS label, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name || 's' END, 'region ' || n_regionkey) AS counterpart FROM nation JOIN region ON r_regionkey = n_regionkey")
def catalog_pairing(spark: SparkSession, d: str) -> DataFrame:
    n = stores.read(spark, d, "nation")
    a = n.select(F.col("n_name").alias("name"), F.concat(F.lit("nation"), F.col("n_regionkey").cast("string")).alias("label"))
    by_name = n.where("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit("s")).alias("name"), F.lit("?").alias("label"))
    by_label = stores.read(spark, d, "region").select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("name"), F.concat(F.lit("Nation "), F.col("r_regionkey").cast("string")).alias("label"))
    return a.join(Q.paired_objects(a, by_name.union(by_label)), "name").select("name", "label", "counterpart")


# Jobs


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """All events, every twentieth of them twice."""
    e = X.change_events(stores.read(spark, d, "events"))
    return e.unionByName(e.where("event_id % 20 = 0"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return J.settled(J.deduplicated(_delivered(spark, d)), F.col("event_id") % 10, F.col("event_id") % 13 == 0)


@_query("WITH " + X.EVENTS + " SELECT event_key, change FROM jobs")
def event_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return J.deduplicated(_delivered(spark, d)).select("event_key", "change")


@_query("WITH " + X.EVENTS + " SELECT event_key, status, attempts FROM jobs")
def job_state_final(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("event_key", "status", "attempts")


@_query("WITH " + X.EVENTS + " SELECT count(*) AS total, 0::BIGINT AS queued, 0::BIGINT AS processing, 0::BIGINT AS retry, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'dead_letter') AS dead_letter, count(*) FILTER (status = 'manual_review') AS manual_review, 0::BIGINT AS dismissed FROM jobs")
def job_stats(spark: SparkSession, d: str) -> DataFrame:
    return J.stats(_jobs(spark, d))


@_query("WITH " + X.EVENTS + " SELECT event_key FROM jobs WHERE event_id % 3 <> 1 AND ts + to_seconds((event_id % 100)::INTEGER) <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 50")
def claim_ready(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_micros(F.unix_micros("occurred_at") + F.col("event_id") % 100 * 1_000_000)
    status = F.element_at(F.array(F.lit("queued"), F.lit("completed"), F.lit("retry")), (F.col("event_id") % 3 + 1).cast("int"))
    jobs = J.deduplicated(_delivered(spark, d)).withColumns({"status": status, "next_attempt_at": at, "created_at": F.col("occurred_at"), "attempts": F.lit(0)})
    return J.claimed(jobs, F.lit("2024-01-20 00:00:00").cast("timestamp"), 50).select("event_key")


@_query("WITH " + X.EVENTS + " SELECT event_key, CASE WHEN n >= 8 THEN 'dead_letter' ELSE 'retry' END AS status, CASE WHEN n < 8 THEN least(60000, 500 * 2 ** greatest(0, n - 1))::BIGINT END AS delay FROM (SELECT *, event_id % 10 AS n FROM jobs)")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    failed = J.after_failure(J.deduplicated(_delivered(spark, d)).withColumn("attempts", F.col("event_id") % 10), now)
    return failed.select("event_key", "status", (F.unix_millis("next_attempt_at") - F.unix_millis(now)).alias("delay"))


_COMMANDS = [("dismiss", "replay", "approve"), ("approve", "dismiss"), ("replay", "dismiss"), ("dismiss", "dismiss"), ("approve", "replay", "replay", "dismiss"), ()]


@_query("WITH " + X.EVENTS + f"""
, s AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'retry' ELSE status END AS st, CASE event_id % 6 {" ".join(f"WHEN {i} THEN {list(c)}" for i, c in enumerate(_COMMANDS) if c)} ELSE []::VARCHAR[] END AS asked FROM jobs)
SELECT event_key, list_reduce(list_prepend(st, asked), lambda s, c: CASE WHEN c = 'replay' THEN 'queued' WHEN c = 'approve' AND change = 'deleted' AND s = 'manual_review' THEN 'completed'
  WHEN c = 'dismiss' AND s IN ('dead_letter', 'manual_review', 'retry') THEN 'dismissed' ELSE s END) AS status, CASE WHEN list_contains(asked, 'replay') THEN 0 ELSE attempts END::INTEGER AS attempts FROM s""")
def job_commands(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).withColumn("status", F.when(F.col("event_id") % 11 == 0, "retry").otherwise(F.col("status")))
    typed = F.array(*[F.array(*[F.lit(x) for x in c]).cast("array<string>") for c in _COMMANDS])
    commands = jobs.select("event_key", F.posexplode(F.element_at(typed, (F.col("event_id") % len(_COMMANDS) + 1).cast("int"))).alias("seq", "command"))
    return J.commanded(jobs, commands.orderBy(F.desc("seq"))).select("event_key", "status", "attempts")


@_query("WITH " + X.EVENTS + " SELECT system, source_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(change, (ts, event_id)) AS change, count(*) AS n_events FROM jobs GROUP BY 1, 2")
def latest_event_per_record(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_per_record(J.deduplicated(_delivered(spark, d)))


@_query("WITH " + X.EVENTS + ", r AS (SELECT system, event_id, row_number() OVER (PARTITION BY system ORDER BY ts DESC, event_id DESC)::INTEGER AS run FROM jobs) SELECT * FROM r WHERE run <= 20")
def last_20_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = J.deduplicated(_delivered(spark, d))
    return J.last_runs(runs, "system", 20, F.col("occurred_at").desc(), F.col("event_id").desc()).select("system", "event_id", "run")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d)
    told = jobs.where("event_id % 2 = 0").select(F.concat_ws(":", "event_key", "status", F.col("attempts").cast("string")).alias("alert_key"))
    return J.new_alerts(jobs, told)


_ALERTS = "WITH " + X.EVENTS + ", alerts AS (SELECT event_id, event_key || ':' || status || ':' || attempts AS alert_key FROM jobs WHERE status <> 'completed' AND event_id % 2 = 1) "


@_query(_ALERTS + "SELECT alert_key FROM alerts")
def new_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d).select("alert_key")


@_query(_ALERTS + "SELECT (SELECT count(*) FROM alerts) AS n_alerts, (SELECT string_agg(alert_key, chr(10) ORDER BY event_id) FROM (SELECT * FROM alerts ORDER BY event_id LIMIT 20)) AS body, (SELECT greatest(0, count(*) - 20) FROM alerts) AS more")
def alert_digest(spark: SparkSession, d: str) -> DataFrame:
    return J.digest(_alerts(spark, d))


_USAGE = "WITH " + X.EVENTS + ", usage AS (SELECT change AS metric, date_trunc('month', ts)::DATE AS month, count(*) AS quantity FROM jobs GROUP BY 1, 2) "


@_query(_USAGE + "SELECT * FROM usage")
def usage_by_month(spark: SparkSession, d: str) -> DataFrame:
    return J.usage(J.deduplicated(_delivered(spark, d)))


@_query(_USAGE + "SELECT metric, quantity, metric <> 'created' OR quantity + 100 <= 1000 AS allowed FROM usage")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([("created", 1000)], "metric string, most long")
    return J.quota(J.usage(J.deduplicated(_delivered(spark, d))), limits, 100).select("metric", "quantity", "allowed")


@_query("WITH " + X.EVENTS + ", c AS (SELECT change, ts::DATE AS day, count(*) AS n FROM jobs GROUP BY 1, 2) SELECT change, day, n, greatest(0, coalesce(n - lag(n) OVER (PARTITION BY change ORDER BY day), 0)) AS increase FROM c")
def status_delta(spark: SparkSession, d: str) -> DataFrame:
    counts = J.deduplicated(_delivered(spark, d)).groupBy("change", F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))
    return J.increases(counts, "change", "day", "n")


@_query("SELECT o_orderkey AS run_id, o_orderstatus AS status, count(*) AS items, sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def run_items_joined(spark: SparkSession, d: str) -> DataFrame:
    items = stores.read(spark, d, "lineitem", ["l_orderkey", "l_quantity"])
    runs = stores.read(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    found = runs.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return found.groupBy(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("items"), F.sum("l_quantity").cast("long").alias("quantity"))


@_query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return stores.read(spark, d, "orders", ["o_orderkey", "o_orderdate"]).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey")


@_query("SELECT r_regionkey AS tenant, kind FROM region CROSS JOIN (VALUES ('contact'), ('company'), ('deal')) v(kind) WHERE NOT (r_regionkey % 2 = 0 AND kind = 'deal')")
def tenant_seed(spark: SparkSession, d: str) -> DataFrame:
    tenants = stores.read(spark, d, "region").select(F.col("r_regionkey").alias("tenant"))
    rows = tenants.withColumn("kind", F.explode(F.array(F.lit("contact"), F.lit("company"), F.lit("deal"))))
    return stores.inserted_if_absent(tenants.where("tenant % 2 = 0").withColumn("kind", F.lit("deal")), rows, ["tenant", "kind"], F.col("kind"))


@_query(X.SQL + "SELECT 'poll:a:' || id || ':' || epoch_ms(modified) AS event_id, 'updated' AS change FROM a WHERE modified >= TIMESTAMP '2024-01-01 08:00:00' UNION ALL SELECT 'poll:a:' || a.id || ':deleted', 'deleted' FROM a ANTI JOIN b ON a.k = b.k")
def poll_union(spark: SparkSession, d: str) -> DataFrame:
    a = X.contact_a(spark, d)
    event = lambda df, last, change: df.select(F.concat_ws(":", F.lit("poll"), F.lit("a"), "id", last).alias("event_id"), F.lit(change).alias("change"))
    changed = event(stores.since(a, "modified", F.lit("2024-01-01 08:00:00").cast("timestamp")), F.unix_millis("modified").cast("string"), "updated")
    gone = stores.deleted_between(a, X.contact_b(spark, d), "k").join(a.select("k", "id"), "k")
    return changed.unionByName(event(gone, F.lit("deleted"), "deleted"))


@_query(X.SQL + "SELECT id, CASE WHEN k % 3 = 0 THEN 'new' ELSE phone END AS phone, title FROM a WHERE k % 5 <> 0 UNION ALL SELECT 'x-' || k, 'new', NULL FROM a WHERE k % 11 = 0")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    a = X.contact_a(spark, d).select("id", "k", "phone", "title")
    patch = a.where("k % 3 = 0").select("id", F.lit("new").alias("phone")).unionByName(a.where("k % 11 = 0").select(F.concat(F.lit("x-"), F.col("k").cast("string")).alias("id"), F.lit("new").alias("phone")))
    return stores.patched(stores.deleted(a, a.where("k % 5 = 0"), ["id"]).drop("k"), patch.join(a.where("k % 5 = 0").select("id"), "id", "left_anti"), ["id"])


# Streams: run over all that is there, then give the result


def _checkpoint(spark: SparkSession) -> str:
    """A new folder in the place that executors share."""
    return f"{stores.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@_query("WITH " + X.EVENTS + " SELECT system, change, count(*) AS n FROM jobs GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = E.counts_by_change(E.unique_events(E.event_stream(spark, d, "events", X.change_events)))
    at = _checkpoint(spark)
    return E.drained(counts, f"{at}/counts", f"{at}/log")


@_query("WITH " + X.EVENTS + " SELECT event_key, change FROM jobs")
def stream_event_store(spark: SparkSession, d: str) -> DataFrame:
    at = _checkpoint(spark)
    for n in ("first", "again"):  # the same events delivered twice over are stored once
        E.into_store(E.event_stream(spark, d, "events", X.change_events), f"{at}/store", f"{at}/{n}").awaitTermination()
    return E.store(spark, f"{at}/store", E.event_stream(spark, d, "events", X.change_events)).select("event_key", "change")


from tandem.plans import fields, operations, syncing, upkeep  # noqa: E402, F401  more queries, which register themselves
