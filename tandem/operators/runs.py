"""Runs over plans: their report, the gates before one is carried out, and what is kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.reconcile import drifted

#: What a plan can do.
ACTIONS = ["create", "update", "match", "skip", "conflict", "ambiguous", "error"]


def outcomes(plans: DataFrame, failed: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Plans as a run leaves them: a record that fails, or is ambiguous when written, becomes an error, and the run goes on.

    failed: (source_id, message) of writes that were refused.
    """
    if dry_run:
        return plans
    rows = plans.join(failed.select("source_id", F.col("message").alias("_message")), "source_id", "left") if failed is not None else plans.withColumn("_message", F.lit(None).cast("string"))
    message = F.coalesce(F.when(F.col("action") == "ambiguous", F.array_join("warnings", "; ")), F.col("_message"))
    bad = message.isNotNull()
    warnings = F.when(bad, F.concat("warnings", F.array(F.left(message, F.lit(2000))))).otherwise(F.col("warnings"))
    return rows.withColumn("warnings", warnings).withColumn("action", F.when(bad, "error").otherwise(F.col("action"))).drop("_message")


def report(done: DataFrame) -> DataFrame:
    """Per type, and for all of them (type null): records read, reconciled and in error, and how many of each action, none left out."""
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    read = F.count("*").alias("read")
    fine = F.count_if(F.col("action") != "error").alias("reconciled")
    return done.rollup("type").agg(read, fine, *counts)


def gates(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """One row: why a frozen plan may not be carried out (empty, ambiguous, mixed_sources, drift), or null if it may.

    All rows are checked before anything is written; drifted counts plans that a new preview no longer confirms.
    """
    checks = frozen.agg(F.count("*").alias("plans"), F.count_if(F.col("action") == "ambiguous").alias("ambiguous"), F.count_distinct("source").alias("sources"))
    lost = drifted(frozen, now).agg(F.count("*").alias("drifted"), F.count_if("gone").alias("gone"))
    why = F.when(F.col("plans") == 0, "empty").when(F.col("ambiguous") > 0, "ambiguous").when(F.col("sources") > 1, "mixed_sources").when(F.col("drifted") > 0, "drift")
    return checks.crossJoin(lost).withColumn("refused", why)  # one row each


def allowed(plans: DataFrame) -> DataFrame:
    """Per plan: the first thing that stands against carrying it out; null if nothing does."""
    same = lambda c: F.coalesce(F.col(c) == F.col("revision"), F.lit(False))
    why = (
        F.when(~(F.col("verified") & same("canary_revision")), "verified_test_record_required").when(~same("preview_revision"), "fresh_preview_required")
        .when(F.col("errors") > 0, "preflight_failed").when(~F.col("schema_hash").eqNullSafe(F.col("planned_hash")), "schema_changed_since_preview")
        .when(F.col("most").isNotNull() & (F.col("used") + F.col("records") > F.col("most")), "plan_limit_exceeded")
    )
    return plans.withColumn("refused", why)


def edited(plans: DataFrame, edits: DataFrame) -> DataFrame:
    """Plans after edits (plan_id, base_revision): each edit of the current revision raises it and clears the preview and the test record; others change nothing."""
    hits = plans.join(edits.select("plan_id", F.col("base_revision").alias("revision"), F.lit(True).alias("_hit")).distinct(), ["plan_id", "revision"], "left")
    kept = lambda c: F.when(F.col("_hit").isNull(), F.col(c)).alias(c)
    cleared = {"preview_revision", "canary_revision"}
    return hits.select(*[kept(c) if c in cleared else (F.col("revision") + F.coalesce(F.col("_hit").cast("int"), F.lit(0))).alias(c) if c == "revision" else F.col(c) for c in plans.columns])


def lifecycle(changes: DataFrame) -> DataFrame:
    """Runs as their begin, complete and fail rows (run_id, at, change, message) leave them; the last of the endings counts."""
    ends = F.col("change").isin("complete", "fail")
    return changes.groupBy("run_id").agg(F.min(F.when(F.col("change") == "begin", F.col("at"))).alias("started_at"), F.max(F.when(ends, F.col("at"))).alias("finished_at"), F.max_by(F.when(ends, F.col("change")), F.when(ends, F.col("at"))).alias("_end"), F.max_by(F.when(ends, F.left("message", F.lit(4000))), F.when(ends, F.col("at"))).alias("message")).select(
        "run_id", "started_at", "finished_at", F.when(F.col("_end") == "complete", "completed").when(F.col("_end") == "fail", "failed").otherwise("running").alias("status"), "message")


def ordered(plans: DataFrame, n: int) -> DataFrame:
    """The first n plans of a run as a report shows them, with whether there are more; carrying out takes all of them."""
    first = plans.orderBy("type", "source_id").limit(n)
    return first.crossJoin(plans.agg((F.count("*") > n).alias("truncated")))  # one row


def activity_counts(activity: DataFrame) -> DataFrame:
    """How many entries of each kind, and the usage that they count for."""
    metric = F.when(F.col("kind") == "sync", "records_synced").when(F.col("kind") == "migrate", "records_migrated").when(F.col("kind") == "conflict", "conflicts_resolved")
    return activity.groupBy("kind").agg(F.count("*").alias("n")).withColumn("metric", metric)


def newest(activity: DataFrame, n: int = 200) -> DataFrame:
    """The newest entries, for display."""
    return activity.orderBy(F.desc("at"), F.desc("id")).limit(n)


def deletion_requests(held: DataFrame, steps: DataFrame) -> DataFrame:
    """Deletion requests (job_id, policy, status, reviewed_by) after steps (job_id, seq, step, policy, actor), the last with the two named as asked or completed.

    The first time that a job asks makes the request: a cascade is completed at once, other policies wait. Asking again changes the policy and leaves the
    status. A completion counts for a request that is there by then. Each is one aggregation by job, so steps may come in any number.
    """
    asked, completed = F.col("step") == "asked", F.col("step") == "completed"
    found = steps.groupBy("job_id").agg(
        F.min(F.when(asked, F.struct("seq", "policy"))).alias("_first"), F.max(F.when(asked, F.struct("seq", "policy"))).alias("_last"), F.max(F.when(completed, F.struct("seq", "actor"))).alias("_done"),
    )
    both = held.select("job_id", F.struct("policy", "status", "reviewed_by").alias("_held")).join(found, "job_id", "full")
    there = F.col("_held").isNotNull()
    done = F.col("_done").isNotNull() & (there | (F.col("_done.seq") > F.col("_first.seq")))
    made = F.when(F.col("_first.policy") == "cascade", "completed").otherwise("pending")
    status = F.when(done, "completed").when(there, F.col("_held.status")).otherwise(made)
    reviewed = F.when(done, F.col("_done.actor")).otherwise(F.col("_held.reviewed_by"))
    return both.where(there | F.col("_first").isNotNull()).select("job_id", F.coalesce("_last.policy", "_held.policy").alias("policy"), status.alias("status"), reviewed.alias("reviewed_by"))


def refused_plans(asked: DataFrame, systems: list[str], known: list[str]) -> DataFrame:
    """Plans asked for (name, source, types, per_type) with why each is refused, null if it is not; types are kept once each, in their order.

    Refused are names that are blank or longer than 120, sources that are no system, no types, unknown types, and limits outside 1 to 100,000.
    """
    name = F.trim(F.coalesce("name", F.lit("")))
    listed = F.coalesce(F.size("types"), F.lit(0))
    strange = F.coalesce(F.exists("types", lambda t: ~F.coalesce(t.isin(known), F.lit(False))), F.lit(False))
    why = (
        F.when((name == "") | (F.length(name) > 120), "name").when(~F.coalesce(F.col("source").isin(systems), F.lit(False)), "source")
        .when((listed < 1) | strange, "types").when(~F.coalesce(F.col("per_type").between(1, 100_000), F.lit(True)), "per_type")
    )
    return asked.withColumn("name", name).withColumn("types", F.array_distinct("types")).withColumn("refused", why)


def poll_summary(polls: DataFrame) -> DataFrame:
    """Polls (type, changed, deleted, error) added up per type and for all of them (type null, zeros if there are none); a poll with an error counts as one."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    each = polls.groupBy("type").agg(total("changed"), total("deleted"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return each.unionByName(each.agg(F.lit(None).cast("string").alias("type"), *[total(c) for c in ("changed", "deleted", "errors")]))


def audited(done: DataFrame, actor: str, action: str, at: Column, kind: str, id_col: str, detail: list[str]) -> DataFrame:
    """Audit rows (actor, action, resource_type, resource_id, detail, at) of what has been done, to be appended under the run's name; detail is a JSON object of some columns."""
    return done.select(
        F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(kind).alias("resource_type"), F.col(id_col).cast("string").alias("resource_id"), F.to_json(F.struct(*detail)).alias("detail"), at.alias("at"),
    )
