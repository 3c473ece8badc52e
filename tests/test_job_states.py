"""Jobs moved by signals over several batches."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from tandem.streaming import jobs as JS

SIGNAL = "event_key string, seq long, signal string, at long"
STATE = "event_key string, seq long, status string, attempts int, next_attempt_at long"


def run(spark, folder, batches, **settings):
    """The rows of each batch, by job."""
    found = []
    with JS.on_disk(spark):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, SIGNAL).coalesce(1).write.mode("append").parquet(str(folder / "signals"))
            states = JS.job_states(spark.readStream.schema(SIGNAL).parquet(str(folder / "signals")), **settings)
            keep = lambda batch, _, n=n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(str(folder / "states"))
            states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder / "log")).trigger(availableNow=True).start().awaitTermination()
            rows = spark.read.schema(f"{STATE}, n int").parquet(str(folder / "states")).where(F.col("n") == n).collect()
            found.append({r.event_key: (r.seq, r.status, r.attempts, r.next_attempt_at) for r in rows})
            assert len(found[-1]) == len(rows)
    return found


def test_signals_count_once_and_in_their_order(spark, tmp_path):
    done = [("done", 0, "enqueue", 10), ("done", 1, "claim", 20), ("done", 2, "fail", 30), ("done", 3, "replay", 40), ("done", 4, "claim", 50), ("done", 5, "succeed", 60)]
    first, second, third = run(spark, tmp_path, [
        [*done, ("late", 2, "fail", 30), ("late", 0, "enqueue", 10), ("unknown", 0, "claim", 10)],
        [("late", 1, "claim", 20), done[3], ("new", 0, "enqueue", 70)],
        [("late", 3, "claim", 529), ("new", 1, "claim", 70), ("new", 2, "delete", 71)],
    ], delete_policy="cascade")
    assert first == {"done": (5, "completed", 1, None), "late": (2, "queued", 0, 10)}
    assert second == {"done": (5, "completed", 1, None), "late": (2, "retry", 1, 530), "new": (0, "queued", 0, 70)}  # the replay came twice and counts once
    assert third == {"late": (3, "retry", 1, 530), "new": (2, "completed", 1, None)}


def test_no_call_for_each_job(spark, tmp_path):
    """Jobs are gathered by an aggregation; Python reads them in batches of columns."""
    spark.createDataFrame([], SIGNAL).write.parquet(str(tmp_path / "signals"))
    plan = JS.job_states(spark.readStream.schema(SIGNAL).parquet(str(tmp_path / "signals")))._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "WithState" not in plan


class Asked:
    """A state and its timers, which count what they are asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), []

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def answer(*args):
            self.asked.append(name)
            return {"get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "registerTimer": self.timers.add, "deleteTimer": self.timers.discard}[name](*args)

        return answer


class Watermark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at


def test_a_timed_job_asks_its_state_little():
    state = Asked()
    told = lambda lease, *signals: list(JS._Timed.handleInputRows(processor(lease), ("j",), (Row(event_key="j", seq=n, signal=s, at=at) for n, s, at in signals), None))

    def processor(lease):
        timed = JS._Timed("manual-review", 8, lease)
        timed.init(state)
        return timed

    (row,) = told(100, (1, "fail", 20), (0, "enqueue", 10))
    assert (row.seq, row.status, row.attempts, row.next_attempt_at) == (1, "retry", 1, 520) and state.timers == {520}
    assert state.asked == ["get", "registerTimer", "update"]
    told(100, (2, "claim", 30))  # too early: nothing changes, nothing is written
    assert state.asked[3:] == ["get"] and state.timers == {520}
    (row,) = told(100, (3, "claim", 530))
    assert (row.status, row.locked_at) == ("processing", 520) and state.timers == {620}
    assert list(processor(1000).handleExpiredTimer(("j",), Watermark(700), None)) == [] and 1520 in state.timers  # a longer lease since the timer was set
    (row,) = processor(1000).handleExpiredTimer(("j",), Watermark(1600), None)
    assert (row.attempts, row.locked_at, row.cause) == (3, 1520, "timer") and 2520 in state.timers
