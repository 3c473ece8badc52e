"""Jobs moved by time, over restarts of the stream."""

from pyspark.sql import functions as F

from tandem.streaming import jobs as JS

SIGNAL = "event_key string, seq long, signal string, at long"
MINUTE = 60_000


def run(spark, folder, rows):
    """One run over new signals; returns the rows that all runs have written."""
    source, out = str(folder / "signals"), str(folder / "states")
    spark.createDataFrame(rows, SIGNAL).coalesce(1).write.mode("append").parquet(source)
    states = JS.timed_states(spark.readStream.schema(SIGNAL).parquet(source), max_attempts=3, delay="1 minute")
    with JS.timers(spark):
        states.writeStream.format("parquet").option("checkpointLocation", str(folder / "log")).trigger(availableNow=True).start(out).awaitTermination()
    last = F.max_by(F.struct("status", "attempts", "cause", "next_attempt_at", "locked_at"), F.struct("at", F.col("cause") == "timer"))
    found = spark.read.schema("event_key string, at long, cause string, status string, attempts int, next_attempt_at long, locked_at long").parquet(out)
    return {r.event_key: tuple(r.l) for r in found.groupBy("event_key").agg(last.alias("l")).where("l.status is not null").collect()}


def test_a_due_retry_and_a_silent_worker_move_by_themselves(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    start = 10 * MINUTE
    first = run(spark, tmp_path, [("fails", 0, "enqueue", start), ("fails", 1, "fail", start + 1000), ("silent", 0, "enqueue", start), ("done", 0, "enqueue", start), ("done", 1, "succeed", start + 5), ("unknown", 0, "claim", start), ("clock", 0, "enqueue", start + 2 * MINUTE)])
    assert first["fails"] == ("processing", 2, "timer", None, start + 1500)  # due half a second after it failed
    assert first["silent"] == ("processing", 1, "timer", None, start) and first["done"] == ("completed", 1, "signal", None, None) and "unknown" not in first
    later = run(spark, tmp_path, [("clock", 1, "succeed", start + 13 * MINUTE)])
    assert later["silent"] == ("processing", 3, "timer", None, start + 10 * MINUTE)  # two leases went by
    assert later["fails"][:2] == ("processing", 4) and later["done"] == first["done"]
    last = run(spark, tmp_path, [("fails", 2, "fail", start + 14 * MINUTE), ("silent", 1, "succeed", start + 14 * MINUTE), ("done", 2, "replay", start + 14 * MINUTE), ("clock", 2, "replay", start + 30 * MINUTE)])
    assert last["fails"] == ("dead_letter", 4, "signal", None, None) and last["silent"] == ("completed", 3, "signal", None, None)
    assert last["done"] == ("processing", 4, "timer", None, start + 29 * MINUTE)  # replayed, claimed at once, and three leases on
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
