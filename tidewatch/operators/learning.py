"""Calibrated phishing classifier and its split: boosted trees with isotonic calibration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import boosting
from tidewatch.operators.baseline import nth_value
from tidewatch.session import cut_lineage

VERSION = "email-classifier-1"
MIN_CALIBRATED = 20
FOLDS = 3  # fitted side by side
_HASH_RANGE = 1 << 52  # whole numbers that a double holds exactly


def _row_hash(id_col: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_HASH_RANGE)).cast("double")


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the rows with the lowest hashes of every label, exactly the share.

    The cut-off per label is found by counting hash ranges, so no label is ever
    sorted in one place.
    """
    hashed = df.withColumn("_h", _row_hash(id_col, seed))
    counts = hashed.groupBy(label_col).agg(F.count("*").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi")).collect()
    chosen = F.lit(False)
    for row in counts:  # one row per label
        k = round(test_share * row["n"])
        if k:
            mine = hashed.filter(F.col(label_col) == row[label_col]).select("_h")
            chosen = chosen | ((F.col(label_col) == row[label_col]) & (F.col("_h") <= nth_value(mine, "_h", k - 1, row["lo"], row["hi"])))
    return hashed.withColumn("is_test", chosen).drop("_h")


@dataclass
class PhishingClassifier:
    """Trees per fold with the calibration of each, and what makes a score auditable."""

    features: list[str]
    trees: list[boosting.BoostedTrees]
    calibrations: list[IsotonicRegressionModel]
    version: str = VERSION
    metrics: dict = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        for i, model in enumerate(self.trees):
            model.save(spark, f"{path}/trees-{i}")
        for i, model in enumerate(self.calibrations):
            model.write().overwrite().save(f"{path}/calibration-{i}")
        row = [("email-classifier", self.version, "classification", "spark-gbt", json.dumps(self.metrics), True, self.features, len(self.trees), len(self.calibrations))]
        schema = (
            "name string, version string, task string, framework string, metrics string, is_active boolean, "
            "features array<string>, n_trees int, n_calibrations int"
        )
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PhishingClassifier:
        row = spark.read.parquet(f"{path}/registry").first()
        return cls(
            list(row["features"]),
            [boosting.BoostedTrees.load(spark, f"{path}/trees-{i}") for i in range(row["n_trees"])],
            [IsotonicRegressionModel.load(f"{path}/calibration-{i}") for i in range(row["n_calibrations"])],
            row["version"],
            json.loads(row["metrics"]),
        )


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    have = set(df.columns)
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0) for f in features}
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumns(filled))


def _fit_trees(rows: DataFrame, iterations: int, seed: int) -> boosting.BoostedTrees:
    return boosting.fit(rows, iterations, seed, side_by_side=FOLDS)


def train_classifier(
    df: DataFrame, features: list[str], label_col: str = "label", id_col: str = "msg_id", iterations: int = 300, folds: int = FOLDS, seed: int = 42,
    version: str = VERSION,
) -> PhishingClassifier:
    """Boosted trees per fold, isotonic calibration on the rows each fold did not see."""
    order = sorted(features)
    rows = _assemble(df, order).select(F.col(id_col), F.col(label_col).cast("double").alias("_y"), "_x")
    # Written once: every boosting round reads the assembled rows again.
    rows = cut_lineage(rows.withColumn("_fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds))))
    total, positive = rows.agg(F.count("*"), F.sum("_y")).first()
    if not positive or positive == total:
        raise ValueError("training needs both classes")
    metrics = {"n_train": int(total), "n_phishing": int(positive), "calibrated": total >= MIN_CALIBRATED}
    if total < MIN_CALIBRATED:
        return PhishingClassifier(order, [_fit_trees(rows, iterations, seed)], [], version, metrics)

    def fit(fold: int) -> tuple[boosting.BoostedTrees, IsotonicRegressionModel]:
        model = _fit_trees(rows.filter(F.col("_fold") != fold), iterations, seed)
        held_out = rows.filter(F.col("_fold") == fold).select("_y", boosting.probabilities([model], F.col("_x"))[0].alias("_p"))
        # Folded to at most 100,001 weighted points before the pooling, whatever the row count.
        points = held_out.groupBy(F.round("_p", 5).alias("p")).agg(F.avg("_y").alias("y"), F.count("*").cast("double").alias("w"))
        return model, IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(points)

    # A boosting round waits for the one before; the folds don't, so their short jobs run side by side.
    with ThreadPool(folds) as pool:
        trees, calibrations = zip(*pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds)))
    return PhishingClassifier(order, list(trees), list(calibrations), version, metrics)


def score_classifier(df: DataFrame, model: PhishingClassifier, out: str = "probability") -> DataFrame:
    """Mean calibrated probability; a feature the rows lack reads as 0."""
    columns = df.columns
    scored = _assemble(df, model.features).withColumn("_raw", boosting.probabilities(model.trees, F.col("_x")))
    parts = []
    for i in range(len(model.trees)):
        scored = scored.withColumn(f"_p{i}", F.col("_raw")[i])
        if model.calibrations:
            calibration = model.calibrations[i].setFeaturesCol(f"_p{i}").setPredictionCol(f"_c{i}")
            scored = calibration.transform(scored)
            parts.append(F.col(f"_c{i}"))
        else:
            parts.append(F.col(f"_p{i}"))
    mean = sum(parts[1:], parts[0]) / len(parts)
    keep = [c for c in columns if c != out]
    return scored.withColumn("_mean", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).select(*keep, F.col("_mean").alias(out))

