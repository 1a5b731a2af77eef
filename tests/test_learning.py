"""Classifier, forecasts and streams."""

import os
import random
import threading
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import boosting
from tidewatch.operators import flows as fl
from tidewatch.operators import forecast as fc
from tidewatch.operators import learning as ln
from tidewatch.plans import registry
from tidewatch.streaming import jobs

SF = "/root/testdata/sf0.001"


def labelled(spark, n):
    r = random.Random(4)
    rows = [(i, float(y := i % 2), y * 2 + r.gauss(0, 0.6), r.random(), float(r.randint(0, 3))) for i in range(n)]
    return spark.createDataFrame(rows, "msg_id long, label double, b double, a double, c double")


def test_classifier_learns_and_round_trips(spark, tmp_path):
    rows = ln.stratified_split(labelled(spark, 400), "msg_id", "label", 0.25).cache()
    assert {r["label"]: r["n"] for r in rows.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {0.0: 50, 1.0: 50}
    model = ln.train_classifier(rows.filter("NOT is_test"), ["b", "a", "c"], iterations=5)
    assert model.features == ["a", "b", "c"] and model.metrics["calibrated"]
    scored = ln.score_classifier(rows.filter("is_test"), model)
    metrics = fl.ranking_metrics(scored.select(F.col("label").cast("int").alias("y"), F.round("probability", 4).alias("score"))).first()
    assert metrics["auc_roc"] > 0.9
    model.save(spark, str(tmp_path))
    again = ln.PhishingClassifier.load(spark, str(tmp_path))
    a = scored.agg(F.sum("probability")).first()[0]
    b = ln.score_classifier(rows.filter("is_test"), again).agg(F.sum("probability")).first()[0]
    assert a == pytest.approx(b)
    missing = ln.score_classifier(rows.select("msg_id"), again).agg(F.min("probability"), F.max("probability")).first()
    assert missing[0] == missing[1]


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    fit, met = ln._fit_trees, threading.Barrier(3)

    def together(rows, iterations, seed):
        met.wait(30)  # breaks unless all folds come here
        return fit(rows, iterations, seed)

    with monkeypatch.context() as m:
        m.setattr(ln, "_fit_trees", together)
        model = ln.train_classifier(labelled(spark, 300), ["b", "a", "c"], iterations=2)
    assert len(model.trees) == len(model.calibrations) == 3 and not met.broken


def vectors(spark, n):
    """Rows of one continuous feature, flags, small numbers and a constant."""
    rows = spark.range(n).select(
        F.col("id").alias("msg_id"), F.round(F.randn(1), 2).alias("a"), (F.rand(2) < 0.5).cast("double").alias("b"), F.floor(F.rand(3) * 7).cast("double").alias("c"),
        F.lit(1.0).alias("d"), F.round(F.rand(4), 2).alias("e"), (F.rand(5) < 0.1).cast("double").alias("f"), F.randn(6).alias("noise"))
    rows = rows.withColumn("_y", (F.expr("a + b * c / 3 - f + noise / 2") > 0.5).cast("double"))
    return ln._assemble(rows, list("abcdef")).select("msg_id", "_y", "_x")


def test_trees_are_those_of_spark(spark):
    rows = vectors(spark, 3000).cache()
    ours = boosting.fit(rows, 12, 7, share=1.0)
    theirs = GBTClassifier(
        featuresCol="_x", labelCol="_y", maxIter=12, stepSize=0.05, maxDepth=5, maxBins=255, subsamplingRate=1.0, featureSubsetStrategy="all", seed=7).fit(rows)
    both = theirs.transform(rows).select(vector_to_array("probability")[1].alias("p"), boosting.probabilities([ours], F.col("_x"))[0].alias("q")).toPandas()
    assert (ours.features >= 0).sum() > 12 * 10
    assert np.abs(both["p"] - both["q"]).max() < 1e-9


def test_boosting_deals_rows_evenly_and_repeats(spark, monkeypatch):
    rows, grow, seen = vectors(spark, 100_000).coalesce(1).cache(), boosting._grow, []

    def look(blocks, *more):
        if not seen:
            seen.extend(blocks.mapPartitions(lambda part: [sum(len(y) for _, y, _, _ in part)]).collect())
        return grow(blocks, *more)

    monkeypatch.setattr(boosting, "_grow", look)
    first = boosting.fit(rows, 3, 7)
    assert len(seen) == 4 and sum(seen) == 100_000 and max(seen) < 1.5 * min(seen)
    again = boosting.fit(rows, 3, 7)
    assert (first.features == again.features).all() and (first.thresholds == again.thresholds).all() and np.allclose(first.values, again.values)


def test_boosting_leaves_no_checkpoints(spark):
    rows = vectors(spark, 500).cache()
    boosting.set_checkpoint_folder(spark)
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path
    before = set(os.listdir(folder))
    model = boosting.fit(rows, 2 * boosting.CHECKPOINT_ROUNDS + 2, 7)
    assert len(model.values) == 2 * boosting.CHECKPOINT_ROUNDS + 2 and set(os.listdir(folder)) == before


def test_cuts_come_from_all_rows():
    values = np.random.default_rng(5).normal(size=200_000)
    points = (np.empty(0), np.empty(0))
    for part in np.split(values, 20):
        points = boosting.merged_points(np.concatenate([points[0], part]), np.concatenate([points[1], np.ones(len(part))]))
    cuts = boosting.cut_points(*points)
    assert len(points[0]) <= boosting.POINTS and points[1].sum() == len(values) and len(cuts) == 254
    ranks = np.searchsorted(np.sort(values), cuts) / len(values)
    assert np.abs(ranks - np.arange(1, 255) / 255).max() < 0.005
    few, counts = boosting.merged_points(np.array([3.0, 1.0, 3.0]), np.array([2.0, 1.0, 5.0]))
    assert few.tolist() == [1.0, 3.0] and counts.tolist() == [1.0, 7.0] and boosting.cut_points(few, counts).tolist() == [2.0]


def test_classifier_refuses_one_class(spark):
    with pytest.raises(ValueError):
        ln.train_classifier(labelled(spark, 30).withColumn("label", F.lit(1.0)), ["a"])


def test_few_rows_are_not_calibrated(spark):
    model = ln.train_classifier(labelled(spark, 12), ["a", "b"], iterations=2)
    assert not model.calibrations and len(model.trees) == 1


def hourly(spark, hours):
    df = spark.range(hours).select(F.lit("s").alias("series"), F.timestamp_seconds(F.col("id") * 3600 + 1704067200).alias("ts"), F.col("id"))
    return df.withColumn("value", (F.hour("ts") * 10 + F.weekday("ts")).cast("double")).drop("id")


def test_seasonal_forecast_is_exact_on_a_seasonal_series(spark):
    series = fc.fill_hours(hourly(spark, 24 * 35))
    got = fc.quantile_forecast(series, 48).collect()
    assert len(got) == 48
    assert all(r["p10"] <= r["p50"] <= r["p90"] and r["p50"] == r["horizon_ts"].hour * 10 + r["horizon_ts"].weekday() for r in got)
    row = fc.rolling_backtest(series, test_days=7).first()
    assert row["mae"] == 0 and row["coverage"] == 1 and row["windows"] == 12


def test_short_series_give_no_forecast(spark):
    series = fc.fill_hours(hourly(spark, 100))
    assert fc.quantile_forecast(series).count() == 0
    gate = fc.history_gate(series).first()
    assert (gate["status"], gate["need_days"]) == ("insufficient_history", 14.0)


def test_half_hourly_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("timestamp,value\n2024-01-01 00:00:00,10\n2024-01-01 00:30:00,20\n2024-01-01 01:00:00,5\n")
    assert [r["value"] for r in fc.read_hourly_csv(spark, str(tmp_path / "x.csv")).orderBy("ts").collect()] == [15.0, 5.0]


def test_incident_change_stream(spark, tmp_path):
    schema = "id long, ts timestamp, tenant_id long, kind string, severity string, entity_count long, status string"
    rows = [(1, 10, 1, "scan", "low", 1, "open"), (1, 20, 1, "scan", "low", 2, "open"), (1, 30, 1, "scan", "high", 2, "open"), (2, 5, 1, "scan", "low", 1, "open")]
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    spark.createDataFrame(rows, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).write.parquet(source)

    def run():
        jobs.write_batches(jobs.incident_change_stream(spark.readStream.schema(schema).parquet(source)), out, state, trigger={"availableNow": True}).awaitTermination()
        return sorted((r["id"], r["severity"], r["status"]) for r in spark.read.parquet(out).collect())

    assert run() == [(1, "high", "open"), (1, "low", "open"), (2, "low", "open")]
    more = spark.createDataFrame([(1, 40, 1, "scan", "high", 3, "open"), (2, 50, 1, "scan", "low", 1, "resolved")], schema.replace("ts timestamp", "ts long"))
    more.withColumn("ts", F.timestamp_seconds("ts")).write.mode("append").parquet(source)
    assert run() == [(1, "high", "open"), (1, "low", "open"), (2, "low", "open"), (2, "low", "resolved")]


def test_streamed_scores_equal_batch_scores(spark):
    live = registry.get_query("x05_scoring_stream")(spark, SF)
    batch = registry.get_query("e05_score_messages")(spark, SF)
    assert live.exceptAll(batch.select(live.columns)).count() == 0 and live.count() == batch.count()


def test_unknown_query_lists_the_known_ones():
    with pytest.raises(KeyError, match="a03_threat_volume"):
        registry.get_query("nope")
