"""Benign baseline: isolation forest plus reconstruction error, fitted and scored on Spark.

The forest is bounded by design (trees x 256 sampled rows), so it is grown from a
bounded sample, one task per group of trees, and travels as a broadcast.  The
reconstruction part is a principal-component model, whose covariance all
executors sum up together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import flows as fl
from tidewatch.session import compiled_methods, cut_lineage

TREES = 200
SAMPLE = 256
DEPTH = 8  # log2 of the sample size
SCORED_ROWS = 4096  # rows that walk through the trees at a time: 1 MB
COMPONENTS = 8
MIN_ROWS = 20
MIN_ROWS_RECONSTRUCTION = 50
VERSION = "flow-baseline-1"


@dataclass
class FlowBaseline:
    """Everything scoring needs; small enough to be broadcast."""

    means: dict[str, float]
    stds: dict[str, float]
    feature: np.ndarray  # (trees, nodes): split feature, -1 at a leaf
    split: np.ndarray
    length: np.ndarray  # path length at a leaf
    sample: int
    center: np.ndarray | None = None
    axes: np.ndarray | None = None
    forest_range: tuple[float, float] = (0.0, 0.0)
    error_range: tuple[float, float] | None = None
    threshold: float = 0.5
    info: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()})

    @classmethod
    def from_json(cls, text: str) -> FlowBaseline:
        d = json.loads(text)
        for name in ("feature", "split", "length", "center", "axes"):
            d[name] = None if d[name] is None else np.array(d[name])
        for name in ("forest_range", "error_range"):
            d[name] = None if d[name] is None else tuple(d[name])
        return cls(**d)

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as one text row, and its registry row next to it."""
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        row = [("flow-baseline", VERSION, "anomaly", "tidewatch", json.dumps(self.info), True)]
        registry = "name string, version string, task string, framework string, metrics string, is_active boolean"
        spark.createDataFrame(row, registry).coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlowBaseline:
        return cls.from_json(spark.read.text(f"{path}/model", wholetext=True).first()[0].strip())


# --- forest -----------------------------------------------------------------------


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One isolation tree as flat arrays of a complete binary tree."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, split, length = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, rows)]
    while todo:
        at, depth, part = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth == DEPTH or len(part) <= 1 or not len(varied):
            length[at] = depth + average_path(len(part))
            continue
        f = rng.choice(varied)
        feature[at], split[at] = f, rng.uniform(low[f], high[f])
        right = part[:, f] > split[at]
        todo += [(2 * at + 1, depth + 1, part[~right]), (2 * at + 2, depth + 1, part[right])]
    return feature, split, length


def _bounded_sample(scaled: DataFrame, id_col: str, n: int, size: int, seed: int) -> np.ndarray:
    """About uniform rows, at most ``size``: hash order, thinned before the sort."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    keep = min(1.0, 1.5 * size / n + 1000 / n)
    thinned = scaled if keep >= 1 else scaled.filter(F.pmod(h, F.lit(1_000_000)) < math.ceil(keep * 1_000_000))
    return thinned.orderBy(h).limit(size).select(*fl.FEATURES).toPandas().to_numpy(dtype=float)


def grow_forest(scaled: DataFrame, id_col: str, n: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    spark = scaled.sparkSession
    pool = _bounded_sample(scaled, id_col, n, min(n, trees * SAMPLE), seed)
    size = min(SAMPLE, len(pool))
    shared = spark.sparkContext.broadcast(pool)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                parts = _grow(shared.value[rng.choice(len(shared.value), size, replace=False)], rng)
                yield pd.DataFrame({"tree": [tree], **{c: [p.tolist()] for c, p in zip(("feature", "split", "length"), parts)}})

    grown = spark.range(0, trees, 1, min(trees, 32)).mapInPandas(
        grow, "tree long, feature array<int>, split array<double>, length array<double>"
    )
    table = grown.toPandas().sort_values("tree")  # trees x 511 numbers: bounded
    return (*(np.stack([np.asarray(v) for v in table[c]]) for c in ("feature", "split", "length")), size)


def _to_the_floor(m: FlowBaseline) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees with all paths ``DEPTH`` long: a leaf sends every row left and hands its length down."""
    leaf = m.feature < 0
    feature, split, length = np.where(leaf, 0, m.feature), np.where(leaf, np.inf, m.split), m.length.copy()
    for at in range(2**DEPTH - 1):
        length[leaf[:, at], 2 * at + 1] = length[leaf[:, at], at]
    return feature, split, length


def _forest_score(x: np.ndarray, m: FlowBaseline) -> np.ndarray:
    """2^(-mean path / expected path): higher is more anomalous."""
    total = np.zeros(len(x))
    trees = list(zip(*_to_the_floor(m)))
    for start in range(0, len(x), SCORED_ROWS):
        part = np.ascontiguousarray(x[start : start + SCORED_ROWS])
        values, first = part.reshape(-1), np.arange(len(part)) * part.shape[1]
        for feature, split, length in trees:
            at = np.zeros(len(part), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (values.take(first + feature.take(at)) > split.take(at))
            total[start : start + SCORED_ROWS] += length.take(at)
    return np.exp2(-(total / len(m.feature)) / max(float(average_path(m.sample)), 1e-9))


def _reconstruction_error(x: np.ndarray, m: FlowBaseline) -> np.ndarray:
    if m.axes is None:
        return np.zeros(len(x))
    centred = x - m.center
    return np.mean((centred - (centred @ m.axes) @ m.axes.T) ** 2, axis=1)


def raw_scores(scaled: DataFrame, model: FlowBaseline) -> DataFrame:
    """Adds ``forest_raw`` and ``error_raw``: both models in one Arrow pass."""
    shared = scaled.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[list(fl.FEATURES)].to_numpy(dtype=float)
            yield batch.assign(forest_raw=_forest_score(values, shared.value), error_raw=_reconstruction_error(values, shared.value))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema.fields)
    return scaled.mapInPandas(score, f"{schema}, forest_raw double, error_raw double")


# --- exact percentile ----------------------------------------------------------------


def nth_value(values: DataFrame, column: str, k: int, low: float, high: float, slices: int = 4096) -> float:
    """The k-th smallest value (from 0): narrow the range slice by slice until one value is left."""
    while low < high:
        inside = values.filter(F.col(column).between(low, high))
        n = F.least(F.floor((F.col(column) - low) / (high - low) * slices), F.lit(slices - 1))
        counts = inside.groupBy(n.alias("s")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for row in sorted(counts.collect(), key=lambda r: r["s"]):  # at most ``slices`` rows
            if k < row["n"]:
                low, high = row["lo"], row["hi"]
                break
            k -= row["n"]
    return low


def exact_percentile(values: DataFrame, column: str, q: float) -> float:
    """Linear-interpolation percentile of any number of rows, without sorting or collecting them."""
    stats = values.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    position = q * (stats["n"] - 1)
    below = math.floor(position)
    first = nth_value(values, column, below, stats["lo"], stats["hi"])
    if position == below:
        return first
    return first + (position - below) * (nth_value(values, column, below + 1, stats["lo"], stats["hi"]) - first)


# --- fit and score -------------------------------------------------------------------


def fit_baseline(
    benign: DataFrame, id_col: str = "flow_id", trees: int = TREES, percentile: float = 0.99, reconstruction: bool = True, seed: int = 42
) -> FlowBaseline:
    """Fit on feature rows taken to be benign; labels are never read."""
    with compiled_methods(benign.sparkSession):
        row = fl.scaler(benign, counted=True).first()
    n = row["n"]
    if n < MIN_ROWS:
        raise ValueError(f"a baseline needs at least {MIN_ROWS} flows, got {n}")
    means, stds = ({f: float(row[f][key]) for f in fl.FEATURES} for key in ("mean", "std"))
    # Written once: sample, covariance, ranges and percentile read thirty numbers per
    # row from here instead of deriving the features again.
    with compiled_methods(benign.sparkSession):
        scaled = cut_lineage(fl.scale(benign.select(id_col, *fl.FEATURES), means, stds))
    model = FlowBaseline(means, stds, *grow_forest(scaled, id_col, n, trees, seed))
    if reconstruction and n >= MIN_ROWS_RECONSTRUCTION:
        center = scaled.agg(*[F.avg(f).alias(f) for f in fl.FEATURES]).first()
        vectors = VectorAssembler(inputCols=list(fl.FEATURES), outputCol="v").transform(scaled).select("v")
        model.center = np.array([float(center[f]) for f in fl.FEATURES])
        model.axes = PCA(k=COMPONENTS, inputCol="v", outputCol="p").fit(vectors).pc.toArray()
    # Written once: the ranges and the percentile read it several times.
    raw = cut_lineage(raw_scores(scaled, model).select("forest_raw", "error_raw"))
    r = raw.agg(F.min("forest_raw"), F.max("forest_raw"), F.min("error_raw"), F.max("error_raw")).first()
    model.forest_range = (float(r[0]), float(r[1]))
    model.error_range = (float(r[2]), float(r[3])) if model.axes is not None else None
    combined = raw.select(combined_score(model).alias("score"))
    model.threshold = float(exact_percentile(combined, "score", percentile))
    model.info = {
        "n_flows": n, "n_features": len(fl.FEATURES), "threshold": model.threshold, "threshold_percentile": percentile,
        "reconstruction": model.axes is not None, "trees": trees,
    }
    return model


def method_scores(model: FlowBaseline) -> dict[str, Column]:
    """Normalised score per method."""
    out = {"isolation_forest": fl.min_max(F.col("forest_raw"), *model.forest_range)}
    if model.error_range is not None:
        out["reconstruction"] = fl.min_max(F.col("error_raw"), *model.error_range)
    return out


def combined_score(model: FlowBaseline) -> Column:
    return fl.ensemble(*method_scores(model).values())


def score_flows(features: DataFrame, model: FlowBaseline) -> DataFrame:
    """Feature rows to (kept columns, score, is_anomaly, threshold, method_scores, attribution)."""
    kept = [c for c in features.columns if c not in fl.FEATURES]
    scored = raw_scores(fl.scale(features, model.means, model.stds), model)
    methods = method_scores(model)
    combined = combined_score(model)
    return scored.select(
        *kept,
        F.round(combined, 4).alias("score"),
        (combined >= model.threshold).alias("is_anomaly"),
        F.lit(round(model.threshold, 4)).alias("threshold"),
        F.create_map(*[x for name, c in methods.items() for x in (F.lit(name), F.round(c, 4))]).alias("method_scores"),
        fl.attribution().alias("attribution"),
        F.lit("model").alias("score_source"),
        F.lit(VERSION).alias("model_version"),
    )


def train_and_evaluate(features: DataFrame, path: str, id_col: str = "flow_id", share: float = 0.7, seed: int = 42, **fitting) -> DataFrame:
    """Fit on a share of the benign rows, store the model, and judge it on all it has not seen.

    Returns the stored model's scores of the held-out rows (the other benign ones and every
    attack), so what is judged is what a later job loads.  The metrics of
    :func:`tidewatch.operators.flows.evaluate` are stored in the model's registry row.
    """
    spark = features.sparkSession
    train, test = fl.benign_split(features, id_col, share, seed)
    model = fit_baseline(train, **fitting)
    model.save(spark, path)
    with compiled_methods(spark):
        scored = cut_lineage(score_flows(test, FlowBaseline.load(spark, path)))
    model.info["metrics"] = {k: v for k, v in fl.evaluate(scored).first().asDict().items() if v is not None}
    model.save(spark, path)
    return scored


def registered_metrics(spark: SparkSession, path: str) -> dict:
    """What the registry row of a stored model says about its held-out rows."""
    return json.loads(spark.read.parquet(f"{path}/registry").first()["metrics"])["metrics"]
