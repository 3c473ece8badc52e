"""Queries over fields and settings: parts stand for the fields of two systems, customers for types with their settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.operators import quality as Q
from tandem.operators import settings as T
from tandem.plans.catalog import _query
from tandem.sources import stores

# Fields: every two parts are one canonical field, of which one is the field of a and the other that of b

_WORDS = ["External Id", "amount", "status", "code", "ref", "Created-By", "email"]
_NAMED = ["name", "phone", "companyName", "id"]
_TYPES = ["boolean", "picklist", "string", "number", "enumeration", "date"]

_FIELDS = f"""
WITH f AS (SELECT p_partkey AS k, p_partkey // 2 AS j, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS system, 'N' || p_partkey AS native, {_TYPES}[p_size % 6 + 1] AS type, p_size % 4 = 0 AS required, p_partkey % 11 = 0 AS read_only,
    p_partkey % 13 = 0 AS calculated, p_name AS label, CASE WHEN p_size % 6 IN (1, 4) THEN [p_type, p_brand] END AS options FROM part),
r AS (SELECT system, k, CASE WHEN j < 4 THEN {_NAMED}[j + 1] ELSE {_WORDS}[j % 7 + 1] || '_' || j END AS canonical, CASE WHEN k % 10 = 3 THEN 'n' ELSE 'N' END || k AS native, CASE WHEN k % 3 = 0 THEN 'trim' END AS read, CASE WHEN k % 4 = 0 THEN 'lowercase' END AS write FROM f WHERE k % 5 <> 4),
typed AS (SELECT r.*, f.type, f.calculated, f.k AS known FROM r LEFT JOIN f USING (system, native)) """


def schemas(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    return stores.read(spark, d, "part").select(
        k.alias("k"), F.when(k % 2 == 0, "a").otherwise("b").alias("system"), F.concat(F.lit("N"), k.cast("string")).alias("native"), pick(_TYPES, size % 6).alias("type"), (size % 4 == 0).alias("required"), (k % 11 == 0).alias("read_only"),
        (k % 13 == 0).alias("calculated"), F.col("p_name").alias("label"), F.when((size % 6).isin(1, 4), F.array("p_type", "p_brand")).alias("options"),
    )


def rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    j = F.floor(k / 2)
    word = F.concat_ws("_", F.element_at(F.array(*map(F.lit, _WORDS)), (j % len(_WORDS) + 1).cast("int")), j.cast("string"))
    name = F.when(j < len(_NAMED), F.get(F.array(*map(F.lit, _NAMED)), j.cast("int"))).otherwise(word)
    native = F.concat(F.when(k % 10 == 3, "n").otherwise("N"), k.cast("string"))
    return stores.read(spark, d, "part", ["p_partkey"]).where(k % 5 != 4).select(
        F.when(k % 2 == 0, "a").otherwise("b").alias("system"), name.alias("canonical"), native.alias("native"), F.when(k % 3 == 0, "trim").alias("read"), F.when(k % 4 == 0, "lowercase").alias("write"), F.lit(False).alias("read_only"),
    )


_ALLOWED = """(length({0}) > 0 AND (({0} LIKE '%external%' AND {0} LIKE '%id') OR NOT ({0} IN ('id', 'type', 'industry', 'website', 'annualrevenue', 'revenue')
  OR regexp_matches({0}, 'modified|activity|created|updated|timestamp|description|notes?|ownerid|recordtype|status|stage|pipeline|amount|employee|count|isdeleted'))))"""


@_query(_FIELDS + ", n AS (SELECT DISTINCT canonical, lower(regexp_replace(canonical, '[^A-Za-z0-9]', '', 'g')) AS key FROM r) SELECT canonical AS field, " + _ALLOWED.format("key") + " AS allowed FROM n")
def key_safety(spark: SparkSession, d: str) -> DataFrame:
    return rules(spark, d).select("canonical").distinct().select(F.col("canonical").alias("field"), S.allowed_natural_key(F.col("canonical")).alias("allowed"))


@_query(_FIELDS + ", n AS (SELECT canonical, lower(regexp_replace(canonical, '[^A-Za-z0-9]', '', 'g')) AS key FROM typed WHERE known IS NOT NULL AND NOT calculated GROUP BY 1 HAVING count(DISTINCT system) = 2) SELECT canonical, lower(canonical) IN ('name', 'phone', 'title', 'companyname') AS risky FROM n WHERE " + _ALLOWED.format("key"))
def key_candidates(spark: SparkSession, d: str) -> DataFrame:
    return Q.key_candidates(rules(spark, d), schemas(spark, d))


@_query(_FIELDS + "SELECT r.system, r.canonical, r.native FROM r JOIN f ON f.system = r.system AND lower(f.native) = lower(r.native) WHERE f.required AND NOT f.read_only")
def required_natives(spark: SparkSession, d: str) -> DataFrame:
    return Q.required_natives(rules(spark, d), schemas(spark, d))


@_query(_FIELDS + ", g AS (SELECT *, CASE WHEN type = 'boolean' THEN 'boolean' WHEN type IN ('enumeration', 'picklist') THEN 'enum' END AS g FROM typed), m AS (SELECT canonical FROM g GROUP BY 1 HAVING count(*) FILTER (g = 'boolean') > 0 AND count(*) FILTER (g = 'enum') > 0) SELECT system, canonical, CASE WHEN g = 'enum' AND canonical IN (FROM m) THEN 'yes-no' ELSE read END AS read, CASE WHEN g = 'enum' AND canonical IN (FROM m) THEN 'yes-no' ELSE write END AS write FROM g")
def boolean_fixes(spark: SparkSession, d: str) -> DataFrame:
    return Q.boolean_fixes(rules(spark, d), schemas(spark, d)).select("system", "canonical", "read", "write")


@_query(_FIELDS + """, t AS (SELECT system, k // 100 AS o, native || '|' || type || '|' || required || '|' || read_only || '|' || label || '|' || coalesce(array_to_string(list_sort(options), chr(31)), '') AS t FROM f),
h AS (SELECT system, o, sha256(string_agg(t, chr(10) ORDER BY t)) AS h FROM t GROUP BY 1, 2) SELECT system || ':' || o AS key, h AS hash FROM h""")
def schema_hash_map(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of schemas of a hundred parts each, as one map of metadata."""
    objects = schemas(spark, d).withColumn("object", F.floor(F.col("k") / 100).cast("string"))
    return Q.hash_map(Q.schema_hashes(objects, ("system", "object")), ["system", "object"], "schema_hash").select(F.explode("hashes").alias("key", "hash"))


@_query(_FIELDS + ", m AS (SELECT system, count(*) AS fields, count(*) FILTER (EXISTS (FROM r WHERE r.system = f.system AND r.native = f.native)) AS mapped FROM f GROUP BY 1) SELECT *, round(100 * mapped / fields)::BIGINT AS percent, CASE WHEN mapped = 0 THEN 'not_started' WHEN mapped < fields THEN 'review' ELSE 'complete' END AS state FROM m")
def mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    return Q.coverage(rules(spark, d), schemas(spark, d))


@_query(_FIELDS + "SELECT canonical FROM r WHERE system = 'a' INTERSECT SELECT canonical FROM r WHERE system = 'b'")
def rules_on_both_sides(spark: SparkSession, d: str) -> DataFrame:
    found = rules(spark, d)
    return found.where("system = 'a'").select("canonical").intersect(found.where("system = 'b'").select("canonical"))


_MAPPED = """
WITH s AS (SELECT c_custkey AS k, 'S-' || c_custkey // 2 AS native, 'Label ' || c_custkey AS label FROM customer),
t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 's-' || c_custkey // 2 ELSE 'T' || c_custkey END AS native, CASE WHEN c_custkey % 5 = 0 THEN 'label ' || c_custkey ELSE 'other' END AS label, c_custkey % 7 = 0 AS read_only FROM customer),
m AS (SELECT s.k, s.native, min(t.k) AS at_ FROM s JOIN (FROM t WHERE NOT read_only) t ON lower(t.native) = lower(s.native) OR lower(t.label) = lower(s.label) GROUP BY 1, 2),
n AS (SELECT *, replace(native, '-', '') AS canonical FROM m WHERE lower(replace(native, '-', '')) NOT IN (SELECT 's' || c_custkey FROM customer WHERE c_custkey % 4 = 0))
SELECT canonical, n.native, t.native AS target FROM (SELECT canonical, min(k) AS k FROM n GROUP BY 1) f JOIN n USING (canonical, k) JOIN t ON t.k = n.at_
"""


@_query(_MAPPED)
def auto_map(spark: SparkSession, d: str) -> DataFrame:
    k, half = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2).cast("string")
    c, name = stores.read(spark, d, "customer", ["c_custkey"]), lambda prefix, x=k.cast("string"): F.concat(F.lit(prefix), x)
    source = c.select(k.alias("position"), name("S-", half).alias("native"), name("Label ").alias("label"))
    target = c.select(k.alias("position"), F.when(k % 3 == 0, name("s-", half)).otherwise(name("T")).alias("native"), F.when(k % 5 == 0, name("label ")).otherwise("other").alias("label"), (k % 7 == 0).alias("read_only"))
    return Q.auto_map(source, target, c.where(k % 4 == 0).select(name("s").alias("canonical")))


# Issues of several checks


_ISSUES = """
WITH i AS (SELECT c_nationkey % 9 AS "check", c_custkey AS position, 'CODE_' || c_mktsegment AS code, repeat(c_name, 20) AS field, repeat(c_name || ' ', 40) AS message FROM customer WHERE c_acctbal < 2500),
n AS (SELECT *, row_number() OVER (ORDER BY "check", position) AS r FROM i WHERE "check" IN (SELECT DISTINCT "check" FROM i ORDER BY 1 LIMIT 3))
SELECT "check", position, left(code, 120) AS code, left(field, 160) AS field, left(message, 500) AS message FROM n WHERE r <= 30"""


@_query(_ISSUES)
def issues_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Issues of nine checks: thirty of the first three are told."""
    c = stores.read(spark, d, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_name", "c_acctbal"]).where("c_acctbal < 2500")
    issues = c.select((F.col("c_nationkey") % 9).alias("check"), F.col("c_custkey").alias("position"), F.concat(F.lit("CODE_"), "c_mktsegment").alias("code"), F.repeat("c_name", F.lit(20)).alias("field"), F.repeat(F.concat("c_name", F.lit(" ")), F.lit(40)).alias("message"))
    return Q.budgeted_issues(issues)


# Settings of types


_SETTINGS = """
WITH d AS (SELECT 't' || c_custkey AS type, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS enabled, CASE c_custkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'a_to_b' WHEN 2 THEN 'b_to_a' END AS direction, CASE WHEN c_custkey % 5 <> 0 THEN 30 END AS interval_minutes, '0 ' || c_custkey % 24 || ' * * *' AS cron FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT 't' || c_custkey AS type, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey % 2 = 0 END AS enabled, CASE WHEN c_custkey % 3 = 1 THEN 'both' END AS direction, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 1 END AS interval_minutes, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 2 THEN '' WHEN 4 THEN '5 * * * *' END AS cron FROM customer WHERE c_custkey % 2 = 0) """


def _settings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, k = stores.read(spark, d, "customer", ["c_custkey", "c_nationkey"]), F.col("c_custkey")
    name, nation = F.concat(F.lit("t"), k.cast("string")).alias("type"), F.col("c_nationkey").cast("int")
    defaults = c.where(k % 3 != 0).select(
        name, F.when(k % 7 != 0, k % 2 == 0).alias("enabled"), F.when(k % 4 == 0, "both").when(k % 4 == 1, "a_to_b").when(k % 4 == 2, "b_to_a").alias("direction"), F.when(k % 5 != 0, 30).alias("interval_minutes"),
        F.concat(F.lit("0 "), (k % 24).cast("string"), F.lit(" * * *")).alias("cron"),
    )
    saved = c.where(k % 2 == 0).select(
        name, F.when(k % 5 != 0, nation % 2 == 0).alias("enabled"), F.when(k % 3 == 1, "both").alias("direction"), F.when(k % 10 == 0, nation + 1).alias("interval_minutes"), F.when((k % 6).isin(0, 2), "").when(k % 6 == 4, "5 * * * *").alias("cron"),
    )
    return defaults, saved


_MERGED = "coalesce(d.type, s.type) AS type, coalesce(s.enabled, d.enabled) AS enabled, coalesce(s.direction, d.direction) AS direction, "


@_query(_SETTINGS + "SELECT * FROM (SELECT " + _MERGED + "coalesce(s.interval_minutes, d.interval_minutes, 30)::INTEGER AS interval_minutes FROM d FULL JOIN s ON s.type = d.type) WHERE enabled IS NOT NULL AND direction IS NOT NULL")
def settings_overlaid(spark: SparkSession, d: str) -> DataFrame:
    """Saved settings over defaults, completed from each other first; types that still lack a value that they need go."""
    defaults, saved = (x.drop("cron") for x in _settings(spark, d))
    return T.overlaid(defaults, saved, required=("enabled", "direction"), fallback={"interval_minutes": 30})


@_query(_SETTINGS + "SELECT " + _MERGED + "coalesce(s.interval_minutes, d.interval_minutes)::INTEGER AS interval_minutes, CASE WHEN s.cron = '' THEN NULL ELSE coalesce(s.cron, d.cron) END AS cron FROM d FULL JOIN s ON s.type = d.type")
def settings_patched(spark: SparkSession, d: str) -> DataFrame:
    """A patch that changes values, clears schedules and brings new types."""
    return T.patched(*_settings(spark, d), clearable=("cron",))
