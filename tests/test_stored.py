"""Stored tables: replays, repeated rows, ties, null keys, failed attempts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.quality import insert_if_absent
from tidewatch.sources import sinks
from tidewatch.sources.stored import commits, insert_batch, stored

SCHEMA = "k string, n int, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(spark, folder):
    return sorted(map(tuple, stored(spark, folder).collect()), key=repr)


def test_each_key_is_kept_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert stored(spark, folder) is None
    first = rows(spark, ("a", 2, "late"), ("a", 1, "z"), ("a", 1, "y"), (None, 1, "no key"), (None, 0, "least"))
    assert insert_batch(first, folder, "b1", ["k"], ["n"])
    assert held(spark, folder) == [("a", 1, "y"), (None, 0, "least")]
    assert not insert_batch(rows(spark, ("new", 1, "")), folder, "b1", ["k"], ["n"])  # a replay, whatever it brings
    assert insert_batch(rows(spark, ("a", 0, "too late"), ("b", 1, "in"), (None, -1, "too late")), folder, "b2", ["k"], ["n"])
    assert held(spark, folder) == [("a", 1, "y"), ("b", 1, "in"), (None, 0, "least")]
    assert insert_batch(rows(spark), folder, "empty", ["k"], ["n"]) and commits(spark, folder).count() == 3


def test_a_failed_attempt_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "t")

    def broken(df, path):
        df.write.parquet(path)
        raise OSError("lost after the part, before the commit")

    with pytest.raises(OSError):
        insert_batch(rows(spark, ("a", 1, "first try")), folder, "b1", ["k"], ["n"], broken)
    assert stored(spark, folder) is None
    assert insert_batch(rows(spark, ("a", 1, "second try")), folder, "b1", ["k"], ["n"])
    assert held(spark, folder) == [("a", 1, "second try")]
    # Two writers that raced for one batch: every reader takes the same one of them.
    rows(spark, ("a", 1, "racer")).write.parquet(f"{folder}/data/part=zz")
    kept = commits(spark, folder).first()
    spark.createDataFrame([("b1", "part=zz", kept["columns"])], "batch string, part string, columns string").coalesce(1).write.parquet(f"{folder}/commits/other")
    assert held(spark, folder) == [("a", 1, "second try")]


def test_detections(spark, tmp_path):
    folder = str(tmp_path / "d")
    assert sinks.read_detections(spark, folder).count() == 0
    day = lambda d: datetime.datetime(2024, 1, d)
    schema = "ts timestamp, tenant_id int, module string, threat_type string, risk_score double, ref_id string, summary string"
    found = spark.createDataFrame(
        [(day(1), 1, "email", "phishing", 0.9, "1", "x"), (day(2), 1, "network", "high_anomaly", 0.75, None, "r"), (None, 1, "news", "fake", 0.2, "3", None)], schema)
    later = spark.createDataFrame([(day(2), 1, "network", "high_anomaly", 0.5, None, "r"), (day(2), 2, "network", "high_anomaly", 0.5, None, "r")], schema)
    for batch, part in (("one", found), ("two", later), ("one", found), ("three", found.unionByName(later))):
        sinks.store_detections(part, folder, batch)
    want = found.unionByName(later.filter("tenant_id = 2"))
    assert sorted(map(tuple, sinks.read_detections(spark, folder).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert sinks.read_detections(spark, folder).schema == want.schema
    assert sinks.read_detections(spark, folder).filter(F.col("module") == "network").count() == 2


def test_stored_keys_are_dropped_before_the_fold(spark, tmp_path):
    """The rows of a key that is there are not folded, and a row travels once in the rank, not beside it."""
    there = str(tmp_path / "there")
    rows(spark, ("a", 1, "x")).write.parquet(there)
    new = insert_if_absent(spark.read.parquet(there), rows(spark, ("a", 0, "y"), ("b", 2, "z"), ("b", 1, "w"), (None, 3, "v")), ["k"], "n")
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_row") < plan.index("LeftAnti") and "min_by" not in plan and plan.index("Aggregate") < plan.index("LeftAnti")
    assert sorted(map(tuple, new.collect()), key=repr) == [("b", 1, "w"), (None, 3, "v")]
