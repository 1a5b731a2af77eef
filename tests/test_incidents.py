"""Incident events over several micro-batches: late rows, ties, forgotten incidents."""

import json
import random

from pyspark.sql import functions as F

from tidewatch.streaming import incidents, jobs

SCHEMA = "id long, at long, change_id long, tenant_id long, kind string, severity string, entity_count long, status string"
NOW = {"availableNow": True}


def stream(spark, source):
    return spark.readStream.schema(SCHEMA.replace("at long", "ts timestamp")).parquet(source)


def add(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at")).drop("at").write.mode("append").parquet(source)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_late_rows_and_ties_are_put_in_order(spark, tmp_path):
    r = random.Random(11)
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    rows = [(r.randint(1, 6), 60 * r.randint(0, 600), i, 1, "scan", r.choice(["low", "high", None]), i, r.choice(["open", "resolved"])) for i in range(400)]
    # arrival: by time, but up to 50 minutes late; the allowance is an hour
    arriving = sorted(rows, key=lambda x: (x[1] + r.randint(0, 3000), x[2]))
    for at in range(0, 400, 80):
        add(spark, source, arriving[at : at + 80])
        finish(incidents.start_incident_events(stream(spark, source), out, state, "1 hour", trigger=NOW))
    got = spark.read.parquet(out).collect()
    final = max(x[1] for x in rows) - 3600
    history = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    want = [x for x in jobs.incident_changes(history).collect() if x["at"] <= final]
    assert len(want) > 50 and sorted((x["id"], x["at"] // 10**6, x["change_id"]) for x in got) == sorted((x["id"], x["at"], x["change_id"]) for x in want)
    by_change = {x[2]: x for x in rows}
    for x in got:
        told = json.loads(x["payload"])
        assert (told["event"], told["id"], told["severity"], told["status"]) == ("incident", x["id"], by_change[x["change_id"]][5], by_change[x["change_id"]][7])
    # a restart without new rows tells nothing again
    finish(incidents.start_incident_events(stream(spark, source), out, state, "1 hour", trigger=NOW))
    assert spark.read.parquet(out).count() == len(got)


def test_silent_incidents_are_forgotten_when_asked(spark, tmp_path):
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for at, change in ((0, 1), (100, 2), (5000, 3), (20000, 4), (90000, 5)):
        add(spark, source, [(1 if change < 5 else 2, 10**6 + at, change, 1, "scan", "low", 1, "open"), (None, 10**6 + at, change, 1, "scan", "low", 1, "open")])
        finish(incidents.start_incident_events(stream(spark, source), out, state, "1 second", forget_ms=10_000_000, trigger=NOW))
    # 100 and 5000 follow within the 10,000 s; 20000 doesn't
    assert sorted(x["change_id"] for x in spark.read.parquet(out).collect()) == [1, 4]
