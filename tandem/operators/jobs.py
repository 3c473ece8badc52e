"""Change events as idempotent jobs, and the tables that tell how they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scalars import backoff_millis

STATUSES = ["queued", "processing", "retry", "completed", "dead_letter", "manual_review", "dismissed"]


def deduplicated(changes: DataFrame) -> DataFrame:
    """Each event once, whenever it is delivered."""
    return changes.dropDuplicates(["event_key"])


def latest_per_record(changes: DataFrame) -> DataFrame:
    last = F.max(F.struct("occurred_at", "event_id", "change")).alias("l")
    return changes.groupBy("system", "source_id").agg(last, F.count("*").alias("n_events")).select("system", "source_id", F.col("l.event_id").alias("event_id"), F.col("l.change").alias("change"), "n_events")


def settled(jobs: DataFrame, failures: Column, ambiguous: Column, delete_policy: str = "manual-review", max_attempts: int = 8) -> DataFrame:
    """Final status and attempts of jobs that fail a known number of times before they succeed.

    Deletes follow the policy (ignore, cascade or manual-review); ambiguous keys are reviewed and never retried.
    """
    deleted = F.col("change") == "deleted"
    review = ambiguous | (deleted if delete_policy == "manual-review" else F.lit(False))
    ignored = deleted if delete_policy == "ignore" else F.lit(False)
    status = F.when(ignored, "completed").when(review, "manual_review").when(failures >= max_attempts, "dead_letter").otherwise("completed")
    attempts = F.when(ignored | review, 1).otherwise(F.least(failures + 1, F.lit(max_attempts)))
    return jobs.withColumn("status", status).withColumn("attempts", attempts.cast("int"))


def after_failure(jobs: DataFrame, now: Column, max_attempts: int = 8) -> DataFrame:
    """Jobs whose attempt, which claiming has counted, has failed: tried again after a delay that doubles, or given up."""
    n, before = F.col("attempts"), F.col("next_attempt_at") if "next_attempt_at" in jobs.columns else F.lit(None)
    return jobs.withColumn("status", F.when(n >= max_attempts, "dead_letter").otherwise("retry")).withColumn("next_attempt_at", F.when(n < max_attempts, F.timestamp_millis(F.unix_millis(now) + backoff_millis(n))).otherwise(before))


def ready(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "retry") & (F.col("next_attempt_at") <= now))


def claimed(jobs: DataFrame, now: Column, k: int) -> DataFrame:
    """The k jobs that have been ready for longest, as processing."""
    return ready(jobs, now).orderBy("created_at", "event_id").limit(k).withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1)


def recovered(jobs: DataFrame, before: Column, now: Column | None = None) -> DataFrame:
    """Jobs whose worker has been silent since before go back to retry, due now, and say so where they have said nothing else."""
    stale = (F.col("status") == "processing") & (F.col("locked_at") < before)
    changed = {"status": F.lit("retry"), "locked_at": F.lit(None), "next_attempt_at": F.current_timestamp() if now is None else now, "last_error": F.coalesce(F.col("last_error"), F.lit("worker lease expired")) if "last_error" in jobs.columns else None}
    return jobs.select(*[F.when(stale, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


def listed(jobs: DataFrame, n: int, status: str | None = None) -> DataFrame:
    """The newest jobs, of one status if it is given, for display."""
    return (jobs if status is None else jobs.where(F.col("status") == status)).orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(n)


def commanded(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Jobs (event_key, change, status, attempts) after commands (event_key, seq, command), each applied to the state that the one before has left.

    A replay starts any job anew; an approval completes a deletion that waits for review; a dismissal ends what waits, has been given up or is to be
    tried again. A command that does not fit is refused, and n_refused counts them. A job's commands are what people have typed.
    """
    asked = commands.where(F.col("command").isNotNull()).groupBy("event_key").agg(F.array_sort(F.collect_list(F.struct("seq", "command"))).alias("_asked"))
    deletion = F.coalesce(F.col("change") == "deleted", F.lit(False))

    def step(state: Column, asked: Column) -> Column:
        c, status = asked["command"], state["status"]
        to = (
            F.when(c == "replay", "queued").when((c == "approve") & deletion & (status == "manual_review"), "completed")
            .when((c == "dismiss") & status.isin("dead_letter", "manual_review", "retry"), "dismissed")
        )
        attempts = F.when(c == "replay", F.lit(0).cast("int")).otherwise(state["attempts"])
        return F.struct(F.coalesce(to, status).alias("status"), attempts.alias("attempts"), (state["n_refused"] + to.isNull().cast("int")).alias("n_refused"))

    start = F.struct(F.col("status").alias("status"), F.col("attempts").cast("int").alias("attempts"), F.lit(0).alias("n_refused"))
    none = F.array().cast("array<struct<seq:bigint,command:string>>")
    end = F.aggregate(F.coalesce(F.transform("_asked", lambda x: F.struct(x["seq"].cast("long").alias("seq"), x["command"].alias("command"))), none), start, step)
    return jobs.join(asked, "event_key", "left").withColumn("_end", end).select(*[F.col("_end")[c].alias(c) if c in ("status", "attempts") else F.col(c) for c in jobs.columns], F.col("_end.n_refused").alias("n_refused"))


def stats(jobs: DataFrame) -> DataFrame:
    """How many jobs are in each status; a status without jobs counts 0."""
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def new_alerts(jobs: DataFrame, alerted: DataFrame) -> DataFrame:
    """Jobs that need attention and of which nothing has been said in this state."""
    key = F.concat_ws(":", "event_key", "status", F.col("attempts").cast("string"))
    return jobs.where(F.col("status").isin("dead_letter", "manual_review")).withColumn("alert_key", key).join(alerted.select("alert_key"), "alert_key", "left_anti")


def digest(alerts: DataFrame, lines: int = 20) -> DataFrame:
    """The number of alerts, the first lines and how many more there are; only those lines leave their tasks."""
    n = alerts.agg(F.count("*").alias("n_alerts"))
    first = alerts.orderBy("event_id").limit(lines).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "alert_key"))), lambda x: x["alert_key"]), "\n").alias("body"))
    return n.crossJoin(first).withColumn("more", F.greatest(F.lit(0), F.col("n_alerts") - lines))  # one row each


def last_runs(runs: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return runs.withColumn("run", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("run") <= n)


def usage(changes: DataFrame) -> DataFrame:
    """Quantity of each metric by calendar month."""
    return changes.groupBy(F.col("change").alias("metric"), F.trunc("occurred_at", "MM").alias("month")).agg(F.count("*").alias("quantity"))


def quota(used: DataFrame, limits: DataFrame, requested: int) -> DataFrame:
    """Whether so much more is allowed; a metric without a limit is."""
    return used.join(limits, "metric", "left").withColumn("allowed", F.col("most").isNull() | (F.col("quantity") + requested <= F.col("most")))


def increases(counts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How far a counter has risen since the snapshot before; the first snapshot and falls count 0."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return counts.withColumn("increase", F.greatest(F.lit(0), F.coalesce(F.col(value) - before, F.lit(0))))


def deletes_carried(jobs: DataFrame, approved: DataFrame, links: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, target) once deletions (event_key, source_id, change, status, policy) have been dealt with.

    One that is being worked at goes by its policy: cascade takes its counterpart from the target and is completed, ignore is completed, any other waits for
    review. One that waits and is approved (event_key) takes its counterpart too and is completed. Without a link there is nothing to take.
    """
    asked = approved.select("event_key", F.lit(True).alias("_approved")).distinct()
    found = jobs.join(asked, "event_key", "left")
    working = (F.col("change") == "deleted") & (F.col("status") == "processing")
    waits = (F.col("change") == "deleted") & (F.col("status") == "manual_review") & F.coalesce("_approved", F.lit(False))
    taken = (working & F.coalesce(F.col("policy") == "cascade", F.lit(False))) | waits
    gone = found.where(taken).select("source_id").distinct().join(links.select("source_id", "target_id"), "source_id").select(F.col("target_id").alias("id"))
    status = F.when(taken | (working & F.coalesce(F.col("policy") == "ignore", F.lit(False))), "completed").when(working, "manual_review").otherwise(F.col("status"))
    return found.withColumn("status", status).drop("_approved"), target.join(gone, "id", "left_anti")


def reported(jobs: DataFrame) -> DataFrame:
    """Jobs as a report shows them: id, the event in one value, times in ISO form, the error left out where there is none."""
    iso = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    event = F.struct(F.col("event_id").alias("eventId"), "system", "type", F.col("source_id").alias("sourceId"), F.col("change").alias("changeType"), iso("occurred_at").alias("occurredAt"))
    row = F.struct(F.col("id"), event.alias("event"), "status", "attempts", iso("next_attempt_at").alias("nextAttemptAt"), F.col("last_error").alias("lastError"), iso("created_at").alias("createdAt"))
    return jobs.select("id", F.to_json(row).alias("report"))
