"""Checks before a run: field rules against both schemas, natural keys, coverage and readiness.

Rules and schemas are small frames of metadata: rules (system, canonical, native, read, write, read_only; read and write name
transforms or are null), schemas (system, native, type, required, read_only, n_options). Key profiles come from the data, over whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import allowed_natural_key, finding_key, plain_name, type_group


def _issue(df: DataFrame, severity: Column | str, code: str, system: str | None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(severity.alias("severity"), F.lit(code).alias("code"), F.lit(system).cast("string").alias("system"), F.col("field"))


def _changes(c: str) -> Column:
    """Whether a transform is named that does something."""
    return F.col(c).isNotNull() & (F.col(c) != "identity")


def preflight(rules: DataFrame, schemas: DataFrame, source_profile: DataFrame | None, target_profile: DataFrame | None, key: str = "natural key") -> DataFrame:
    """Issues (severity, code, system, field) of moving records from a to b; issues of both sides at once have no system.

    A dotted path is known if its first part is; where the source has a field of the whole name, that one counts. Targets that a rule or
    the schema marks as read-only need not be there or be mapped. A profile that could not be taken is told as such.
    """
    of = lambda df, system: df.where(F.col("system") == system).drop("system")
    ra, rb, sa, sb = of(rules, "a"), of(rules, "b"), of(schemas, "a"), of(schemas, "b")
    dotted, root = F.contains("native", F.lit(".")), F.element_at(F.split("native", r"\."), 1)
    known = sa.select(F.col("native").alias("_native"), F.col("type").alias("_type"), F.col("n_options").alias("_options"))
    roots = known.toDF("_root", "_root_type", "_root_options")
    source = ra.withColumn("_root", root).join(known, F.col("native") == F.col("_native"), "left").join(roots, "_root", "left")
    source = source.withColumn("type_a", F.coalesce("_type", "_root_type")).withColumn("options_a", F.when(F.col("_native").isNotNull(), F.col("_options")).otherwise(F.col("_root_options")))
    unknown = source.where(F.col("type_a").isNull()).withColumn("field", F.col("native"))
    there = sb.select("native", F.col("type").alias("type_b"), F.col("required"), F.col("read_only").alias("fixed"), F.col("n_options").alias("options_b"))
    target = rb.join(there, "native", "left").withColumn("field", F.col("native"))
    both_ways = lambda r, w: _changes(r) & _changes(w)
    one = source.select("canonical", "type_a", "options_a", both_ways("read", "write").alias("solved_a"))
    both = target.where(F.col("type_b").isNotNull()).join(one.where(F.col("type_a").isNotNull()), "canonical").withColumn("field", F.col("canonical"))
    differs = both.where((type_group(F.col("type_b")) != type_group(F.col("type_a"))) & ~(both_ways("read", "write") | F.col("solved_a")))
    free = ~F.col("read_only") & ~dotted
    found = [
        _issue(unknown.where(dotted), "warning", "RELATIONSHIP_FIELD_UNVERIFIED", "a"),
        _issue(unknown.where(~dotted), "error", "SOURCE_FIELD_MISSING", "a"),
        _issue(target.where(F.col("type_b").isNull() & free), "error", "TARGET_FIELD_MISSING", "b"),
        _issue(target.where(F.col("fixed") & ~F.col("read_only")), "error", "TARGET_FIELD_READ_ONLY", "b"),
        _issue(differs, F.when(F.col("read").isNotNull() | F.col("write").isNotNull(), "warning").otherwise("error"), "FIELD_TYPE_MISMATCH", None),
        _issue(both.where((F.col("options_b") > 0) & (F.col("options_a") > 0)), "warning", "ENUM_VALUES_REQUIRE_REVIEW", None),
        _issue(sb.where(F.col("required") & ~F.col("read_only")).join(rb.select("native"), "native", "left_anti").withColumn("field", F.col("native")), "error", "REQUIRED_TARGET_UNMAPPED", "b"),
    ]
    if source_profile is None or target_profile is None:
        found.append(_issue(rules.sparkSession.range(1).select(F.lit(key).alias("field")), "warning", "NATURAL_KEY_PROFILE_UNAVAILABLE", None))
    else:
        profile = lambda df, c: df.where(F.col(c) > 0).select(F.lit(key).alias("field"))
        found += [
            _issue(profile(source_profile, "missing"), "warning", "NATURAL_KEY_MISSING_VALUES", "a"),
            _issue(profile(source_profile, "duplicate_keys"), "warning", "SOURCE_NATURAL_KEY_DUPLICATES", "a"),
            _issue(profile(target_profile, "duplicate_keys"), "error", "TARGET_NATURAL_KEY_DUPLICATES", "b"),
        ]
    return reduce(DataFrame.unionByName, found)


def boolean_fixes(rules: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rules with yes-no set both ways on the list side of each pair of a boolean and a list field."""
    typed = rules.join(schemas.select("system", "native", type_group(F.col("type")).alias("_group")), ["system", "native"], "left")
    pair = typed.groupBy("canonical").agg(F.collect_set("_group").alias("_groups"))
    mixed = F.array_contains("_groups", "boolean") & F.array_contains("_groups", "enum") & (F.col("_group") == "enum")
    fixed = lambda c: F.when(F.coalesce(mixed, F.lit(False)), "yes-no").otherwise(F.col(c)).alias(c)
    return typed.join(pair, "canonical").select("system", "canonical", "native", fixed("read"), fixed("write"), "read_only")


def required_natives(rules: DataFrame, schemas: DataFrame) -> DataFrame:
    """Fields (system, canonical, native) that a record written there must hold, whatever the case of their names."""
    needed = schemas.where(F.col("required") & ~F.col("read_only")).select("system", F.lower("native").alias("_n"))
    return rules.withColumn("_n", F.lower("native")).join(needed, ["system", "_n"]).select("system", "canonical", "native")


#: Canonical fields that may change or not be unique.
_MUTABLE = ("name", "phone", "title", "companyname")


def key_candidates(rules: DataFrame, schemas: DataFrame) -> DataFrame:
    """Canonical fields that rules of both sides map to known fields, none of them calculated, and that a natural key may use; risky ones can change or be shared."""
    calculated = F.coalesce("calculated", F.lit(False)) if "calculated" in schemas.columns else F.lit(False)
    fields = schemas.where(~calculated).select("system", "native")
    both = rules.join(fields, ["system", "native"]).groupBy("canonical").agg(F.count_distinct("system").alias("_sides"))
    found = both.where((F.col("_sides") == 2) & allowed_natural_key(F.col("canonical")))
    return found.select("canonical", F.lower("canonical").isin(*_MUTABLE).alias("risky"))


def verified_findings(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings that name an issue that is there, each once (the first by order), with the issue's own severity."""
    key = lambda: finding_key(F.col("code"), F.col("system"), F.col("field")).alias("_key")
    first = findings.withColumn("_key", key()).groupBy("_key").agg(F.min_by("explanation", "position").alias("explanation"))
    return issues.select("severity", "code", "system", "field", key()).dropDuplicates(["_key"]).join(first, "_key").drop("_key")


def capped_issues(issues: DataFrame, most: int = 30, width: int = 200) -> DataFrame:
    """What is shown of many issues: errors first, at most so many, with texts cut; a report's limit, not a step of a job."""
    shown = issues.orderBy(F.col("severity") != "error", "code", "system", "field").limit(most)
    return shown.select("severity", "code", "system", F.left("field", F.lit(width)).alias("field"))


def budgeted_issues(issues: DataFrame, most: int = 30, checks: int = 3) -> DataFrame:
    """What is told of the issues (check, position, code, field, message) of several checks: those of the first checks, in order, until a budget that the checks share
    is used up; texts are cut. A report's limit, not a step of a job.

    A check's first rows are ranked by check, so that no more than the budget leaves a check of any size; what a check may still use is the budget less the
    running total of the checks before it.
    """
    rank = F.row_number().over(Window.partitionBy("check").orderBy("position"))
    first = issues.withColumn("_rank", rank).where(F.col("_rank") <= most)
    sizes = first.groupBy("check").agg(F.count("*").alias("_n")).orderBy("check").limit(checks)
    used = F.coalesce(F.sum("_n").over(Window.orderBy("check").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over so many checks
    shown = first.join(F.broadcast(sizes.withColumn("_used", used)), "check").where(F.col("_used") + F.col("_rank") <= most)
    return shown.select("check", "position", F.left("code", F.lit(120)).alias("code"), F.left("field", F.lit(160)).alias("field"), F.left("message", F.lit(500)).alias("message"))


def coverage(rules: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per system: fields, those mapped, their share in per cent, and the state that this makes."""
    mapped = schemas.join(rules.select("system", "native", F.lit(1).alias("_m")).distinct(), ["system", "native"], "left")
    n, m = F.count("*"), F.count("_m")
    state = F.when(m == 0, "not_started").when(m < n, "review").otherwise("complete")
    return mapped.groupBy("system").agg(n.alias("fields"), m.alias("mapped"), F.round(100 * m / n).cast("long").alias("percent"), state.alias("state"))


def coverage_states(covered: DataFrame) -> DataFrame:
    """How many objects are in each state of coverage; a state without objects counts 0."""
    return covered.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("not_started", "review", "complete")])


def checked(issues: DataFrame, schemas: DataFrame) -> DataFrame:
    """The summary of a check: readiness, and how many fields were looked at."""
    return readiness(issues).crossJoin(schemas.agg(F.count("*").alias("fields_checked")))  # one row each


def readiness(issues: DataFrame) -> DataFrame:
    """Errors block, warnings ask for review, otherwise the run is ready."""
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return issues.agg(errors.alias("errors"), warnings.alias("warnings"), (errors == 0).alias("ok"), F.when(errors > 0, "blocked").when(warnings > 0, "review_required").otherwise("ready").alias("readiness"))


def schema_hashes(schemas: DataFrame, keys: tuple[str, ...] = ("system",)) -> DataFrame:
    """A hash of each schema (the fields of one object), whatever the order of its fields and options; labels and options count where they are given."""
    text = {c: F.col(c).cast("string") for c in ("native", "type", "required", "read_only", "label") if c in schemas.columns}
    if "options" in schemas.columns:
        text["options"] = F.array_join(F.array_sort("options"), "\x1f")
    row = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in text.values()])
    return schemas.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("schema_hash"))


def hash_map(hashes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One map of all hashes, by keys joined with a colon; metadata only."""
    return hashes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", *keys).alias("k"), F.col(value).alias("v"))))).alias("hashes"))


def map_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values are not the same on both sides; none if the maps are equal."""
    both = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), key, "full")
    return both.where(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_in_a").eqNullSafe(F.col("_in_b")))).select(key, F.col("_a").alias("before"), F.col("_b").alias("now"))


def paired_objects(a: DataFrame, b: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Objects (name, label) of a with their counterpart in b: the registered one, else by plain name, else by label; equality joins, the first match counts."""
    by = lambda df, c, out: df.groupBy(plain_name(F.col(c)).alias("_k")).agg(F.min("name").alias(out))
    found = a.withColumn("_k", plain_name(F.col("name"))).join(by(b, "name", "_n"), "_k", "left").drop("_k")
    found = found.withColumn("_k", plain_name(F.col("label"))).join(by(b, "label", "_l"), "_k", "left")
    if registry is None:
        return found.select("name", F.coalesce("_n", "_l").alias("counterpart"))
    known = registry.groupBy(F.col("native_a").alias("name")).agg(F.min("native_b").alias("_r"))
    return found.join(known, "name", "left").select("name", F.coalesce("_r", "_n", "_l").alias("counterpart"))


def catalog(objects: DataFrame, registered: DataFrame, rules: DataFrame) -> DataFrame:
    """Objects (name, label) that are no companions of others, with how many fields rules map; registered ones first, then by label."""
    companion = F.col("name").rlike("(History|Feed|Share|ChangeEvent|Tag)$") | F.contains(F.col("label"), F.lit("__MISSING LABEL__"))  # fixed values
    mapped = rules.groupBy("name").agg(F.count_distinct("native").alias("mapped_fields"))
    known = registered.select("name").distinct().withColumn("registered", F.lit(True))
    rows = objects.where(~F.coalesce(companion, F.lit(False))).join(known, "name", "left").join(mapped, "name", "left")
    return rows.select("name", "label", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("mapped_fields", F.lit(0)).cast("long").alias("mapped_fields")).orderBy(F.desc("registered"), "label")


def auto_map(source: DataFrame, target: DataFrame, used: DataFrame) -> DataFrame:
    """New rules (canonical, native, target): source fields (position, native, label) with the first writable target field of the same name or label.

    The canonical name is the source's without signs; one that a rule (used: canonical) has already is left alone, and of several fields that would share one the first
    counts. Names and labels are alike whatever their case.
    """
    free = target.where(~F.coalesce("read_only", F.lit(False)))
    by = lambda c, out: free.groupBy(F.lower(c).alias("_k")).agg(F.min(F.struct("position", F.col("native").alias("target"))).alias(out))
    found = source.withColumn("_k", F.lower("native")).join(by("native", "_n"), "_k", "left").drop("_k")
    found = found.withColumn("_k", F.lower("label")).join(by("label", "_l"), "_k", "left").drop("_k").withColumn("_t", F.least("_n", "_l")).where("_t IS NOT NULL")
    named = found.withColumn("canonical", F.regexp_replace("native", "[^a-zA-Z0-9]", "")).withColumn("_c", F.lower("canonical")).where("_c <> ''")
    new = named.join(used.select(F.lower("canonical").alias("_c")), "_c", "left_anti")
    return new.groupBy("_c").agg(F.min(F.struct("position", "canonical", "native", F.col("_t.target").alias("target"))).alias("f")).select("f.canonical", "f.native", "f.target")


def option_values(a: DataFrame, b: DataFrame, saved: DataFrame) -> DataFrame:
    """Values of a list field on either side, with what has been saved for them."""
    both = a.select("value").union(b.select("value")).distinct()
    return both.join(saved.select("value", "canonical"), "value", "full").select("value", F.coalesce("canonical", "value").alias("canonical"))


def searched(rows: DataFrame, query: str, columns: list[str], facet: Column | None = None) -> DataFrame:
    """Rows that hold the text, in whatever case, in one of the columns or across them (joined by spaces), and pass the facet; a blank text finds all."""
    wanted = query.strip().lower()
    text = F.concat_ws(" ", *[F.coalesce(F.lower(c), F.lit("")) for c in columns])
    found = rows.where(text.contains(wanted)) if wanted else rows
    return found if facet is None else found.where(facet)
