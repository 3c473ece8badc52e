"""The polled source and published tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tandem.sources import polling, versions

DAY = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)


def changes(spark, path, days, mode="append"):
    rows = [(f"r{d}", d % 3, DAY + datetime.timedelta(days=d)) for d in days]
    spark.createDataFrame(rows, "id string, n int, at timestamp").coalesce(1).write.mode(mode).parquet(path)


def polled(spark, path, log, out, now, **more):
    polling.register(spark)
    rows = spark.readStream.format("polled").options(path=path, changed="at", now=(DAY + datetime.timedelta(days=now)).isoformat(), **more).load()
    rows.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()
    return sorted(r.id for r in spark.read.schema("id string").parquet(out).collect())


def test_a_poll_reads_what_is_new_since_the_last_one_began(spark, tmp_path):
    path, log, out = (str(tmp_path / x) for x in ("table", "log", "out"))
    changes(spark, path, range(1, 9))
    assert polled(spark, path, log, out, 6, lookbackDays=3) == ["r3", "r4", "r5"]
    assert polled(spark, path, log, out, 6) == ["r3", "r4", "r5"]
    changes(spark, path, [2, 11])
    assert polled(spark, path, log, out, 12) == ["r11", "r3", "r4", "r5", "r6", "r7", "r8"]


def test_files_are_dealt_to_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    for d in (1, 5, 9):
        changes(spark, path, [d])
    monkeypatch.setattr(polling, "PARTS", 2)
    reader = polling.Polled({"path": path, "changed": "at"}).streamReader(spark.read.parquet(path).schema)
    span = [{"since": (DAY + datetime.timedelta(days=d)).isoformat()} for d in (4, 9)]
    parts = reader.partitions(*span)
    assert sorted(len(p.paths) for p in parts) == [1, 2]
    assert [x for p in parts for b in reader.read(p) for x in b.column("id").to_pylist()] == ["r5"]


def test_comparisons_are_applied_by_the_source(spark, tmp_path):
    path = str(tmp_path / "table")
    changes(spark, path, range(1, 9))
    polling.register(spark)
    rows = spark.read.format("polled").options(path=path, changed="at").load()
    asked = rows.where((F.col("at") > F.lit(DAY + datetime.timedelta(days=3))) & (F.col("n") == 2) & F.col("id").like("r%"))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "LIKE" in plan or "StartsWith" in plan
    assert not any("(n#" in line and "= 2" in line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line)
    assert sorted(r.id for r in asked.collect()) == ["r5", "r8"]
    for other in (rows.where("n is null"), rows.where("n > null"), rows.where("n = 2.5")):
        assert other.collect() == []


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    assert versions.version(spark, path) is None
    with pytest.raises(ValueError):
        versions.opened(spark, path)
    assert versions.append(df, path, "b1") == 1
    before = versions.opened(spark, path)
    assert versions.append(spark.range(5, 7), path, "b2") == 2 and versions.append(spark.range(5, 7), path, "b2") == 2
    assert (before.count(), versions.opened(spark, path).count(), versions.opened(spark, path, 1).count()) == (5, 7, 5)
    assert versions.replace(versions.opened(spark, path).where("id > 3"), path) == 3 and versions.opened(spark, path).count() == 3
    with pytest.raises(ValueError):
        versions.append(df.withColumn("x", F.lit(1)), path)
    lost = spark.range(99)
    lost.write.parquet(f"{path}/data/lost")  # a write whose manifest never came
    assert versions.opened(spark, path).count() == 3


def test_upserts_lay_changes_over(spark, tmp_path):
    path = str(tmp_path / "t")
    of = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    versions.upsert(of((1, "a"), (2, "b")), path, ["k"])
    versions.upsert(of((2, "c"), (3, None)), path, ["k"])
    assert sorted(map(tuple, versions.opened(spark, path).collect())) == [(1, "a"), (2, "c"), (3, None)]
