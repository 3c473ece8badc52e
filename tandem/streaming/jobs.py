"""Jobs as state machines over a stream of signals, one for each event key.

A job is queued once, is claimed when it is due (one more attempt), and then succeeds, fails, proves ambiguous or is a deletion. A failure is
tried again after a delay that doubles, and given up at the last attempt; what is ambiguous, and deletions where the policy says so, wait
for a person. A replay puts any job at the start, an approval completes a deletion that waits, a dismissal ends what waits, has been given up or
is to be tried again. Signals that do not fit the state change nothing, so redelivery is harmless.

With timers nobody has to ask: a job that is due is claimed by itself, and one whose worker has been silent for the time of a lease is
taken from it and claimed anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "status string, attempts int, next_attempt_at long, locked_at long, deletion boolean"
#: Milliseconds that a worker may be silent.
LEASE = 300_000


class Job(NamedTuple):
    """What is known of a job: status (null before it is known), attempts, when it is due, since when it is worked at, and whether it is a deletion."""

    status: str | None = None
    attempts: int = 0
    due: int | None = None
    locked: int | None = None
    deletion: bool = False


def moved(job: Job, signal: str, at: int, delete_policy: str = "manual-review", max_attempts: int = 8) -> Job:
    """The job after a signal at a time in milliseconds."""
    to = lambda status, **more: job._replace(status=status, due=None, locked=None, **more)
    status = job.status
    if signal == "enqueue":
        return Job("queued", 0, at) if status is None else job
    if status is None:
        return job
    if signal == "claim" and status in ("queued", "retry") and job.due <= at:
        return to("processing", attempts=job.attempts + 1)._replace(locked=at)
    if status == "processing":
        if signal == "fail":
            return to("dead_letter") if job.attempts >= max_attempts else to("retry")._replace(due=at + min(60_000, 500 * 2 ** max(0, job.attempts - 1)))
        if signal == "delete":
            return to("manual_review" if delete_policy == "manual-review" else "completed", deletion=True)
        if signal in ("succeed", "ambiguous"):
            return to("completed" if signal == "succeed" else "manual_review")
    if signal == "replay":
        return to("queued", attempts=0)._replace(due=at)
    if signal == "approve" and status == "manual_review" and job.deletion:
        return to("completed")
    if signal == "dismiss" and status in ("dead_letter", "manual_review", "retry"):
        return to("dismissed")
    return job


def elapsed(job: Job, at: int, lease: int = LEASE) -> Job:
    """The job at a time by which nothing but time has passed: claimed when it was due, and again after each lease that went by in silence."""
    if job.status in ("queued", "retry") and job.due is not None and job.due <= at:
        job = job._replace(status="processing", attempts=job.attempts + 1, locked=job.due, due=None)
    if job.status == "processing" and job.locked is not None and (n := (at - job.locked) // lease) > 0:
        job = job._replace(attempts=job.attempts + n, locked=job.locked + n * lease)
    return job


def deadline(job: Job, lease: int = LEASE) -> int | None:
    """When time will move the job next."""
    return job.due if job.status in ("queued", "retry") else job.locked + lease if job.status == "processing" and job.locked is not None else None


def job_states(signals: DataFrame, delete_policy: str = "manual-review", max_attempts: int = 8) -> DataFrame:
    """(event_key, seq, status, attempts, next_attempt_at): the state of each job after the last of its signals so far, for the jobs that a batch names.

    signals: a stream of (event_key, seq, signal, at), at in milliseconds; seq orders the signals of a job, in whatever batches they come. The state holds the
    signals of each job, each once however often it is delivered; they are gathered by an aggregation that needs no call per job, and read as columns.
    Best with a state store on disk (see on_disk).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("signals")
            signs, ends = given.flatten(), np.cumsum(pc.list_value_length(given).to_numpy(zero_copy_only=False)).tolist()
            seqs, names, ats = (signs.field(c).to_pylist() for c in ("seq", "signal", "at"))
            done, begin = [], 0
            for key, end in zip(batch.column("event_key").to_pylist(), ends):
                now = Job()
                for i in range(begin, end):
                    now = moved(now, names[i], ats[i], delete_policy, max_attempts)
                if now.status is not None:
                    done.append((key, seqs[end - 1], now.status, now.attempts, now.due))
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["event_key", "seq", "status", "attempts", "next_attempt_at"])

    told = F.struct(F.col("seq").cast("long").alias("seq"), "signal", F.col("at").cast("long").alias("at"))
    known = signals.groupBy(F.col("event_key").cast("string").alias("event_key")).agg(F.sort_array(F.collect_set(told)).alias("signals"))
    return known.mapInArrow(run, "event_key string, seq long, status string, attempts int, next_attempt_at long")


class _Timed(StatefulProcessor):
    """Keeps a job and one timer for its deadline. What time has done is worked out to the moment of a signal, or to the watermark, whichever timer fires late.

    A job is asked for once and written once in a call, and its timer is told from it, since each question to the state is a round trip.
    """

    def __init__(self, delete_policy: str, max_attempts: int, lease: int):
        self.delete_policy, self.max_attempts, self.lease = delete_policy, max_attempts, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _kept(self, key: tuple, before: Job, job: Job, cause: str, seq: int | None, at: int) -> Row:
        old, due = deadline(before, self.lease), deadline(job, self.lease)
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if due is not None and old != due:
            self.handle.registerTimer(due)
        if job != before:
            self.job.update(tuple(job))
        return Row(event_key=key[0], seq=seq, at=at, cause=cause, status=job.status, attempts=job.attempts, next_attempt_at=job.due, locked_at=job.locked)

    def handleInputRows(self, key, rows, timerValues):
        before = job = Job(*(self.job.get() or ()))
        signals = sorted(((r.at, r.seq, r.signal) for r in rows), key=itemgetter(0, 1))  # the signals of one job in one batch
        for at, _, signal in signals:
            job = moved(elapsed(job, at, self.lease), signal, at, self.delete_policy, self.max_attempts)
        yield self._kept(key, before, job, "signal", signals[-1][1], signals[-1][0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        before = Job(*self.job.get())
        job = elapsed(before, now, self.lease)
        if job != before:
            yield self._kept(key, before, job, "timer", None, now)
        elif (due := deadline(job, self.lease)) is not None:
            self.handle.registerTimer(due)  # the lease has been changed since

    def close(self) -> None:
        pass


def timed_states(signals: DataFrame, delete_policy: str = "manual-review", max_attempts: int = 8, lease: int = LEASE, delay: str = "10 minutes") -> DataFrame:
    """(event_key, seq, at, cause, status, attempts, next_attempt_at, locked_at): jobs as signals and time move them; the last row of a job is its state.

    signals: a stream of (event_key, seq, signal, at), at in milliseconds and signals of a job in order but for a delay. Time is event time: it is as late as the watermark.
    The stream needs a state store that keeps timers (see timers).
    """
    moments = signals.withColumn("moment", F.timestamp_millis("at")).withWatermark("moment", delay)
    out = "event_key string, seq long, at long, cause string, status string, attempts int, next_attempt_at long, locked_at long"
    return moments.groupBy("event_key").transformWithState(_Timed(delete_policy, max_attempts, lease), out, "append", "eventTime")


@contextmanager
def on_disk(spark: SparkSession):
    """Streams started in here keep their state in RocksDB, within a bound of memory for each executor; each batch saves what has changed."""
    store = "spark.sql.streaming.stateStore"
    new = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.boundedMemoryUsage": "true",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {name: spark.conf.get(name, None) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Timers need such a store.
timers = on_disk
